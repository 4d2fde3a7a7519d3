"""The registered queries in SQL, for an engine with the sample tables as views.

Written from the definition of each operator, not from its Spark plan: joins where the
library aggregates once, plain windows where it splits them, recursion where it
streams.
"""

from __future__ import annotations

from habitus.config import FEATURES, RULE_WEIGHTS, SERVED_COLUMNS

_KEY = "CAST(regexp_extract(props, '[0-9]+') AS INT)"

_LOGS = f"""
logon AS (
  SELECT ts AS date, CAST(user_id AS VARCHAR) AS "user", CAST({_KEY} % 7 AS VARCHAR) AS pc,
         CASE WHEN event_type = 'signup' THEN 'Logoff' ELSE 'Logon' END AS activity
  FROM events WHERE event_type IN ('view', 'click', 'signup')),
device AS (
  SELECT ts AS date, CAST(user_id AS VARCHAR) AS "user", CAST({_KEY} % 7 AS VARCHAR) AS pc,
         CASE WHEN event_type = 'purchase' THEN 'Connect' ELSE 'Disconnect' END AS activity
  FROM events WHERE event_type IN ('purchase', 'error')),
users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_mktsegment AS role, n_name AS department,
         r_name AS team, c_acctbal, c_nationkey
  FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey)
    ON c_nationkey = n_nationkey)"""

_OFF = "(hour(date) >= 20 OR hour(date) < 6)"

_EVENT_DAYS = f"""{_LOGS},
logon_days AS (
  SELECT "user", CAST(date AS DATE) AS day, count(*) AS logon_count,
         count(*) FILTER ({_OFF}) AS off_hours_logon_count,
         count(DISTINCT pc) AS distinct_pcs,
         min(hour(date)) AS first_logon_hour, max(hour(date)) AS last_logon_hour
  FROM logon WHERE activity = 'Logon' GROUP BY 1, 2),
device_days AS (
  SELECT "user", CAST(date AS DATE) AS day, count(*) AS usb_connect_count,
         count(*) FILTER ({_OFF}) AS off_hours_usb_count
  FROM device WHERE activity = 'Connect' GROUP BY 1, 2),
event_days AS (
  SELECT "user", day,
         coalesce(logon_count, 0) AS logon_count,
         coalesce(off_hours_logon_count, 0) AS off_hours_logon_count,
         coalesce(distinct_pcs, 0) AS distinct_pcs,
         first_logon_hour, last_logon_hour,
         coalesce(usb_connect_count, 0) AS usb_connect_count,
         coalesce(off_hours_usb_count, 0) AS off_hours_usb_count
  FROM logon_days FULL OUTER JOIN device_days USING ("user", day)),
event_features AS (
  SELECT event_days.*, role, department, team
  FROM event_days LEFT JOIN users ON "user" = user_id)"""

_SHIPPING_DAYS = """
shipping_days AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS "user", CAST(l_shipdate AS DATE) AS day,
         count(*) AS logon_count,
         count(*) FILTER (l_returnflag = 'R') AS off_hours_logon_count,
         count(DISTINCT l_partkey) AS distinct_pcs,
         count(*) FILTER (l_linestatus = 'O') AS usb_connect_count,
         count(*) FILTER (l_quantity > 40) AS off_hours_usb_count
  FROM lineitem GROUP BY 1, 2),
shipping_features AS (
  SELECT shipping_days.*, r_name AS role, n_name AS department, s_name AS team
  FROM shipping_days
  LEFT JOIN supplier ON "user" = CAST(s_suppkey AS VARCHAR)
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""


def _each(template: str, names=FEATURES, glue: str = ",\n         ") -> str:
    return glue.join(template.replace("#", name) for name in names)


def _with_z(days: str) -> str:
    """``moments``, ``baseline`` and ``scored_z`` over a table of actor days."""
    return f"""
moments AS (
  SELECT "user", {_each("count(#) AS n_#, sum(#) AS s_#, sum(# * #) AS q_#")}
  FROM {days} GROUP BY "user"),
baseline AS (
  SELECT "user", {_each('''CAST(s_# AS DOUBLE) / n_# AS mean_#,
         CASE WHEN n_# > 1 THEN nullif(sqrt(
           CAST(n_# * q_# - s_# * s_# AS DOUBLE) / CAST(n_# * (n_# - 1) AS DOUBLE)), 0)
         END AS std_#''')}
  FROM moments),
scored_z AS (
  SELECT d.*, {_each("b.mean_#, b.std_#, coalesce((d.# - b.mean_#) / b.std_#, 0) AS z_#")}
  FROM {days} d JOIN baseline b USING ("user"))"""


def _rule_text(name: str, counterfactual: bool = True) -> str:
    label = name.replace("_", " ")
    text = f"printf('{label} unusually high for this user (z=%.1f)', z_{name})"
    if counterfactual:
        text += (
            f" || CASE WHEN std_{name} > 0 THEN printf("
            f"' — would not flag below %.1f (actual: %.0f)', mean_{name} + 2.5 * std_{name}, "
            f"mean_{name} + z_{name} * std_{name}) ELSE '' END"
        )
    return f"CASE WHEN z_{name} > 2.5 THEN {text} END"


_ORDERED = tuple(name for name, _ in RULE_WEIGHTS)
_RULE_SCORE = "CAST(" + " + ".join(
    f"CASE WHEN z_{name} > 2.5 THEN {weight} ELSE 0 END" for name, weight in RULE_WEIGHTS
) + " AS DOUBLE)"
_RULE_TEXTS = ", ".join(_rule_text(name) for name in _ORDERED)
_BARE_TEXTS = ", ".join(_rule_text(name, False) for name in _ORDERED)
_MODEL_TEXT = "'Flagged as multivariate outlier by anomaly model'"


def _reasons(texts: str) -> str:
    return f"coalesce(nullif(concat_ws('; ', {texts}), ''), 'No specific rule triggered')"


def _level(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 8 THEN 'Critical' WHEN {score} >= 5 THEN 'High' "
        f"WHEN {score} >= 2 THEN 'Medium' WHEN {score} > 0 THEN 'Low' ELSE 'Normal' END"
    )


_DRIFT_TEXTS = ", ".join(
    f"CASE WHEN drift_z_{name} > 3 THEN printf('sustained rise in {name.replace('_', ' ')} "
    f"over the trailing 14 days (recent avg %.1f vs personal baseline %.1f, trend z=%.1f)', "
    f"recent_{name}, mean_{name}, drift_z_{name}) END"
    for name in FEATURES
)

_DRIFT = f"""
recent AS (
  SELECT *, {_each("CASE WHEN count(*) OVER w >= 14 THEN CAST(sum(#) OVER w AS DOUBLE) / 14 END AS recent_#")}
  FROM scored_z
  WINDOW w AS (PARTITION BY "user" ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
drifted AS (
  SELECT *, {_each("coalesce((recent_# - mean_#) / (std_# / sqrt(14)), 0) AS drift_z_#")}
  FROM recent)"""

_SHIPPING_Z = f"WITH {_SHIPPING_DAYS}, {_with_z('shipping_features')}"
_SHIPPING_DRIFT = f"{_SHIPPING_Z}, {_DRIFT}"
_SCORES = f"""{_SHIPPING_DRIFT},
scores AS (
  SELECT "user", day, role, department, team, {_level(_RULE_SCORE)} AS severity,
         {_RULE_SCORE} AS severity_score, {_reasons(_RULE_TEXTS)} AS reasons,
         {", ".join(FEATURES)}, false AS iso_anomaly,
         {_each("drift_z_# > 3", glue=" OR ")} AS drift_flag,
         concat_ws('; ', {_DRIFT_TEXTS}) AS drift_reasons
  FROM drifted),
threat_base AS (SELECT * FROM scores WHERE severity <> 'Normal' OR drift_flag)"""

_LOW = ", ".join(f"min(p[{k}])" for k in range(1, 6))
_HIGH = ", ".join(f"max(p[{k}])" for k in range(1, 6))
_PATH = """CASE WHEN {0} <= 1 THEN 0.0::DOUBLE WHEN {0} = 2 THEN 1.0::DOUBLE
  ELSE 2.0::DOUBLE * (ln(({0} - 1)::DOUBLE) + 0.5772156649015329::DOUBLE)
     - 2.0::DOUBLE * ({0} - 1)::DOUBLE / {0}::DOUBLE END"""


def _split(ranges: str) -> str:
    """Varying features of each (t, slot), the one that splits it and where."""
    return f"""
  SELECT *, CASE WHEN raw >= hi[chosen] THEN lo[chosen] ELSE raw END AS cut FROM (
    SELECT *, lo[chosen] + (('0x' || substr(h, 9, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE)
        * (hi[chosen] - lo[chosen]) AS raw FROM (
      SELECT *, varying[1 + ('0x' || substr(h, 1, 8))::BIGINT % greatest(1, len(varying))] AS chosen FROM (
        SELECT *, md5('42:' || t || ':' || slot) AS h,
          list_filter([1, 2, 3, 4, 5], lambda k: hi[k] > lo[k]) AS varying FROM ({ranges}))))"""


def _forest(days: str) -> str:
    """The forest grown level by level, and each distinct vector walked down every tree.

    ``vector_scores`` has iso_score_raw and iso_anomaly by vector; ``threshold`` the quantile.
    """
    point = "[" + ", ".join(f"CAST(coalesce({name}, 0) AS DOUBLE)" for name in FEATURES) + "]"
    over = "OVER (PARTITION BY t, slot)"
    low = ", ".join(f"min(p[{k}]) {over}" for k in range(1, 6))
    high = ", ".join(f"max(p[{k}]) {over}" for k in range(1, 6))
    inside = f"SELECT *, [{low}] AS lo, [{high}] AS hi FROM grown WHERE depth < (SELECT height FROM size)"
    whole = f"SELECT t, slot, depth, count(*) AS n, [{_LOW}] AS lo, [{_HIGH}] AS hi FROM grown GROUP BY ALL"
    return f"""
vectors AS (
  SELECT p, count(*) AS rows, md5(array_to_string(list_transform(p, lambda x: x::VARCHAR), ',')) AS key
  FROM (SELECT {point} AS p FROM {days}) GROUP BY p),
numbered AS (SELECT *, CAST(sum(rows) OVER (ORDER BY key, p) AS BIGINT) AS upto FROM vectors),
size AS (
  SELECT n, m, greatest(1, ceil(log2(greatest(m, 2))))::INT AS height
  FROM (SELECT sum(rows)::BIGINT AS n, least(256, sum(rows))::BIGINT AS m FROM vectors)),
draws AS (
  SELECT t, k * n // m + ('0x' || substr(md5('42:' || t || ':' || k), 1, 15))::BIGINT
    % ((k + 1) * n // m - k * n // m) AS at_rank
  FROM range(200) trees(t), range(256) strata(k), size WHERE k < m),
grown AS (
  SELECT t, 0::BIGINT AS slot, 0 AS depth, p
  FROM draws JOIN numbered ON at_rank >= upto - rows AND at_rank < upto
  UNION ALL
  SELECT t, 2 * slot + CASE WHEN p[chosen] > cut THEN 2 ELSE 1 END, depth + 1, p
  FROM ({_split(inside)}) WHERE len(varying) > 0),
nodes AS (
  SELECT t, slot, depth, n, chosen, cut, len(varying) = 0 OR depth = (SELECT height FROM size) AS leaf
  FROM ({_split(whole)})),
walked AS (
  SELECT p, t, 0::BIGINT AS slot FROM vectors, range(200) trees(t)
  UNION ALL
  SELECT p, t, 2 * slot + CASE WHEN p[chosen] > cut THEN 2 ELSE 1 END
  FROM walked JOIN nodes USING (t, slot) WHERE NOT leaf),
path_totals AS (
  SELECT p, CAST(sum(CAST(round((depth + {_PATH.format("n")}) * 16777216) AS BIGINT)) AS BIGINT) AS total
  FROM walked JOIN nodes USING (t, slot) WHERE leaf GROUP BY p),
ranked_totals AS (
  SELECT total, sum(sum(rows)) OVER (ORDER BY total) AS upto
  FROM path_totals JOIN vectors USING (p) GROUP BY total),
threshold AS (
  SELECT (SELECT min(total) FROM ranked_totals WHERE upto > floor(0.02::DOUBLE * (n - 1))) AS low,
    coalesce((SELECT min(total) FROM ranked_totals WHERE upto > floor(0.02::DOUBLE * (n - 1)) + 1),
      (SELECT max(total) FROM ranked_totals)) AS high,
    0.02::DOUBLE * (n - 1) - floor(0.02::DOUBLE * (n - 1)) AS fraction,
    greatest({_PATH.format("m")}, 1e-12::DOUBLE) * 16777216::DOUBLE * 200 AS scale, n FROM size),
vector_scores AS (
  SELECT p, s - (low_s + (high_s - low_s) * fraction) AS iso_score_raw FROM (
    SELECT p, fraction, -pow(2.0::DOUBLE, -(total::DOUBLE / scale)) AS s,
      -pow(2.0::DOUBLE, -(low::DOUBLE / scale)) AS low_s, -pow(2.0::DOUBLE, -(high::DOUBLE / scale)) AS high_s
    FROM path_totals, threshold))"""


_POINT = "[" + ", ".join(f"CAST(coalesce(d.{name}, 0) AS DOUBLE)" for name in FEATURES) + "]"
_BY_MODEL = f"({_RULE_SCORE} + CASE WHEN iso_score_raw < 0 THEN 2 ELSE 0 END)"
_DETECTED = f"""{_SHIPPING_DRIFT.replace("WITH", "WITH RECURSIVE", 1)}, {_forest("shipping_features")},
scores AS (
  SELECT d."user", d.day, role, department, team, {_level(_BY_MODEL)} AS severity,
         {_BY_MODEL} AS severity_score,
         {_reasons(_RULE_TEXTS + ", CASE WHEN iso_score_raw < 0 THEN " + _MODEL_TEXT + " END")} AS reasons,
         {", ".join(FEATURES)}, iso_score_raw < 0 AS iso_anomaly, iso_score_raw,
         {_each("drift_z_# > 3", glue=" OR ")} AS drift_flag,
         concat_ws('; ', {_DRIFT_TEXTS}) AS drift_reasons
  FROM drifted d JOIN vector_scores v ON v.p = {_POINT}),
threat_base AS (SELECT * FROM scores WHERE severity <> 'Normal' OR drift_flag)"""

_DAY = "strftime(day, '%Y-%m-%d') AS day"
_RECORD_PARTS = {
    "day": _DAY,
    "user": '"user"',
    "role": "coalesce(role, 'Unknown') AS role",
    "department": "coalesce(department, 'Unknown') AS department",
    "team": "coalesce(team, 'Unknown') AS team",
    **{name: f"CAST({name} AS DOUBLE) AS {name}" for name in FEATURES},
}
_RECORD = ", ".join(_RECORD_PARTS.get(name, name) for name in SERVED_COLUMNS)
_RANKED = 'ORDER BY severity_score DESC, "user", scores.day'
_BREAKDOWN = ", ".join(
    f"count(*) FILTER (severity = '{name}') AS {name.lower()}"
    for name in ("Normal", "Low", "Medium", "High", "Critical")
)
_PREVIEW = f'"user", {_DAY}, severity, severity_score, role, department, reasons'


def _matching(where: str) -> str:
    return f"{_SCORES} SELECT {_RECORD} FROM threat_base AS scores WHERE {where}"


def _page(where: str, limit: int = 500, offset: int = 0) -> str:
    return f"{_matching(where)} {_RANKED} LIMIT {limit} OFFSET {offset}"


_ANY = "severity <> 'Normal'"
_HEADER = f"""{_SCORES},
firsts AS (
  SELECT "user", coalesce(role, 'Unknown') AS role,
         coalesce(department, 'Unknown') AS department, coalesce(team, 'Unknown') AS team
  FROM scores QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY day) = 1)
SELECT "user", f.role, f.department, f.team, count(*) AS total_days,
       count(*) FILTER (severity <> 'Normal') AS flagged_days, {_BREAKDOWN},
       bool_or(drift_flag) AS any_drift
FROM scores JOIN firsts f USING ("user")"""

_US = "epoch_us({0}) AS {0}_us"

_ACCESSES = f"""
accesses AS (
  SELECT CASE WHEN event_type IN ('view', 'purchase') THEN 'analyst-' || user_id
              ELSE '10.0.0.' || user_id END AS accessor,
         {_KEY} AS user_id, event_type <> 'error' AS found, date_trunc('second', ts) AS ts
  FROM events)"""

_AUDIT = f"""WITH {_ACCESSES}
SELECT accessor, count(*) AS lookups, count(DISTINCT user_id) AS distinct_users,
       CAST(count(*) FILTER (NOT found) AS DOUBLE) / count(*) AS not_found_share,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_access,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_access
FROM accesses GROUP BY accessor"""

_REQUESTS = """
seconds AS (
  SELECT CAST(user_id AS VARCHAR) AS client, ts, count(*) AS requests
  FROM events GROUP BY 1, 2)"""

# One step per client and instant; ``held`` has one entry per request let in.
_THROTTLE = f"""WITH RECURSIVE {_REQUESTS},
numbered AS (
  SELECT client, ts, epoch_us(ts) AS s, requests,
         row_number() OVER (PARTITION BY client ORDER BY ts) AS i
  FROM seconds),
steps AS (
  SELECT client, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS held,
         CAST(NULL AS TIMESTAMP) AS ts, CAST(0 AS BIGINT) AS s,
         CAST(0 AS BIGINT) AS requests, CAST(0 AS BIGINT) AS admitted
  FROM seconds GROUP BY client
  UNION ALL
  SELECT client, i,
         list_concat(live, [s FOR x IN range(least(requests, greatest(0, 3 - len(live))))]),
         ts, s, requests, least(requests, greatest(0, 3 - len(live)))
  FROM (
    SELECT n.client, n.i, n.ts, n.s, n.requests,
           [x FOR x IN p.held IF x >= n.s - 21600000000] AS live
    FROM steps p JOIN numbered n ON n.client = p.client AND n.i = p.i + 1))
SELECT client, {_US.format("ts")}, requests, admitted, requests - admitted AS refused,
       CASE WHEN requests > admitted THEN (held[1] + 21600000000 - s) // 1000000 + 1 END AS retry_after
FROM steps WHERE i > 0"""


def _events(select: str) -> str:
    return f"WITH {_EVENT_DAYS} {select}"


_PROFILE = " UNION ALL ".join(
    f"SELECT '{name}' AS feature, count({name}) AS count, "
    f"CAST(sum({name}) AS DOUBLE) / count({name}) AS mean, "
    f"sqrt(CAST(count({name}) * sum({name} * {name}) - sum({name}) * sum({name}) AS DOUBLE) "
    f"/ CAST(count({name}) * (count({name}) - 1) AS DOUBLE)) AS std, "
    f"CAST(min({name}) AS DOUBLE) AS min, CAST(quantile_cont({name}, 0.25) AS DOUBLE) AS p25, "
    f"CAST(quantile_cont({name}, 0.5) AS DOUBLE) AS p50, "
    f"CAST(quantile_cont({name}, 0.75) AS DOUBLE) AS p75, CAST(max({name}) AS DOUBLE) AS max "
    f"FROM event_features"
    for name in (
        "logon_count",
        "off_hours_logon_count",
        "distinct_pcs",
        "first_logon_hour",
        "last_logon_hour",
        "usb_connect_count",
        "off_hours_usb_count",
    )
)

_COUNTS = (
    "logon_count, off_hours_logon_count, distinct_pcs, CAST(first_logon_hour AS INT) AS "
    "first_logon_hour, CAST(last_logon_hour AS INT) AS last_logon_hour, usb_connect_count, "
    "off_hours_usb_count"
)
_DISPLAY = """CASE WHEN NOT drift_flag THEN reasons
       WHEN reasons = 'No specific rule triggered' THEN drift_reasons
       ELSE reasons || '; ' || drift_reasons END AS table_reason,
  CASE WHEN severity <> 'Normal' AND drift_flag THEN reasons || '; ' || drift_reasons
       WHEN severity <> 'Normal' THEN reasons ELSE drift_reasons END AS history_reason"""
_OUTLIER = "(off_hours_usb_count >= 3 OR logon_count >= 5)"
_BONUS = f"({_RULE_SCORE} + CASE WHEN {_OUTLIER} THEN 2 ELSE 0 END)"
_STATS = f"""{_SCORES} SELECT count(DISTINCT "user") AS total_users,
  count(*) AS total_user_days, count(*) FILTER (severity <> 'Normal') AS total_flagged,
  {_BREAKDOWN}, count(*) FILTER (drift_flag) AS drift_flagged,
  count(*) FILTER (severity = 'Normal' AND drift_flag) AS drift_only,
  strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day
  FROM scores"""
_SUMMARY = f"""{_SCORES} SELECT count(*) AS user_days,
  count(*) FILTER (severity <> 'Normal') AS flagged,
  count(*) FILTER (severity = 'Normal' AND drift_flag) AS drift_only FROM scores"""
_CSV = "strftime(date, '%Y-%m-%d %H:%M:%S') AS date, \"user\", pc, activity"

ORACLES: dict[str, str] = {
    "load_summary": f"WITH {_LOGS} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS log, count(*) AS rows, "
        f"epoch_us(min(date)) AS first_date_us, epoch_us(max(date)) AS last_date_us FROM {name}"
        for name in ("logon", "device")
    )
    + " UNION ALL SELECT 'users', count(*), NULL, NULL FROM users",
    "csv_logon": f"WITH {_LOGS} SELECT {_CSV} FROM logon",
    "csv_logon_rejects": f"""WITH {_LOGS},
marked AS (SELECT *, coalesce(pc = '3' AND activity = 'Logoff', false) AS wrong FROM logon)
SELECT {_CSV}, NULL AS line, NULL AS file_kind FROM marked WHERE NOT wrong
UNION ALL SELECT NULL, NULL, NULL, NULL, 'n/a,' || "user" || ',' || pc || ',' || activity, 'csv' FROM marked WHERE wrong""",
    "csv_device": f"WITH {_LOGS} SELECT {_CSV} FROM device",
    "csv_users": f"""WITH {_LOGS} SELECT user_id, role, department, team,
  CASE WHEN c_acctbal >= 0 THEN strftime(DATE '2009-12-31' + c_nationkey, '%Y-%m-%d 00:00:00')
  END AS start_date, CAST(NULL AS VARCHAR) AS end_date FROM users""",
    "logon_features": _events(
        f'SELECT "user", {_DAY}, logon_count, off_hours_logon_count, distinct_pcs, '
        "CAST(first_logon_hour AS INT) AS first_logon_hour, "
        "CAST(last_logon_hour AS INT) AS last_logon_hour FROM logon_days"
    ),
    "device_features": _events(
        f'SELECT "user", {_DAY}, usb_connect_count, off_hours_usb_count FROM device_days'
    ),
    "merged_features": _events(f'SELECT "user", {_DAY}, {_COUNTS} FROM event_days'),
    "feature_table": _events(
        f'SELECT "user", {_DAY}, {_COUNTS}, role, department, team FROM event_features'
    ),
    "feature_summary": _events(
        'SELECT count(*) AS user_days, count(DISTINCT "user") AS users FROM event_features'
    ),
    "feature_profile": _events(_PROFILE),
    "sample_rows": _events(
        f'SELECT "user", {_DAY}, {_COUNTS}, role, department, team FROM event_features '
        'ORDER BY "user", event_features.day LIMIT 10'
    ),
    "repeated_users": "SELECT c_mktsegment || '/' || c_nationkey AS user_id, "
    "count(*) AS entries FROM customer GROUP BY 1 HAVING count(*) > 1",
    "baseline_merged": f"{_SHIPPING_Z} SELECT * FROM baseline",
    "actor_baseline": f"{_SHIPPING_Z} SELECT * FROM baseline",
    "zscores": f'{_SHIPPING_Z} SELECT "user", {_DAY}, {_each("z_#, mean_#, std_#")} FROM scored_z',
    "zscores_merged": f'{_SHIPPING_Z} SELECT "user", {_DAY}, {_each("z_#, mean_#, std_#")} FROM scored_z',
    "zscores_events": f"WITH {_EVENT_DAYS}, {_with_z('event_features')} "
    f'SELECT "user", {_DAY}, {_each("z_#")} FROM scored_z',
    "rule_scores": f'{_SHIPPING_Z} SELECT "user", {_DAY}, {_RULE_SCORE} AS rule_score FROM scored_z',
    "rule_reasons": f'{_SHIPPING_Z} SELECT "user", {_DAY}, {_RULE_SCORE} AS rule_score, '
    f"{_reasons(_RULE_TEXTS)} AS reasons FROM scored_z",
    "rule_reasons_without_baseline": f"WITH {_EVENT_DAYS}, {_with_z('event_features')} "
    f'SELECT "user", {_DAY}, {_RULE_SCORE} AS rule_score, '
    f"{_reasons(_BARE_TEXTS)} AS reasons FROM scored_z",
    "counterfactual_ceiling": f'{_SHIPPING_Z} SELECT "user", {_DAY}, '
    f"{_each('mean_# + 2.5 * std_# AS ceiling_#')} FROM scored_z",
    "severity": f'{_SHIPPING_Z} SELECT "user", {_DAY}, CAST({_BONUS} AS DOUBLE) AS severity_score, '
    f"{_level(_BONUS)} AS severity, "
    f"{_reasons(f'{_RULE_TEXTS}, CASE WHEN {_OUTLIER} THEN {_MODEL_TEXT} END')} AS reasons "
    "FROM scored_z",
    "drift_zscores": f'{_SHIPPING_DRIFT} SELECT "user", {_DAY}, '
    f"{_each('recent_#, drift_z_#')} FROM drifted",
    "drift_stream": f'{_SCORES} SELECT "user", {_DAY}, drift_flag, drift_reasons FROM scores',
    "drift_signal": f'{_SCORES} SELECT "user", {_DAY}, drift_flag, drift_reasons FROM scores',
    "drift_only": f'{_SCORES} SELECT "user", {_DAY}, severity, drift_reasons FROM scores '
    "WHERE severity = 'Normal' AND drift_flag",
    "severity_breakdown": f"{_SCORES} SELECT severity, count(*) AS user_days FROM scores "
    "GROUP BY severity",
    "stats": _STATS,
    "stats_record": f"""{_SCORES},
levels AS (SELECT unnest(['Normal', 'Low', 'Medium', 'High', 'Critical']) AS severity)
SELECT (SELECT count(*) FROM scores) AS total_user_days, severity, count("user") AS user_days,
  (SELECT strftime(min(day), '%Y-%m-%d') FROM scores) AS "start",
  (SELECT strftime(max(day), '%Y-%m-%d') FROM scores) AS "end"
FROM levels LEFT JOIN scores USING (severity) GROUP BY severity""",
    "run_summary": _SUMMARY,
    "threats_page": _page(_ANY),
    "threats_second_page": _page(_ANY, 100, 100),
    "threats_deep_page": _page(_ANY, 500, 2000),
    "threats_page_after": _page(_ANY, 100, 100),
    "matching_high": _matching("severity IN ('High', 'Critical')"),
    "matching_include_drift": _matching("severity = 'Critical' OR drift_flag"),
    "matching_normal": _matching("true"),
    "matching_search": _matching(f"{_ANY} AND \"user\" ILIKE '%1%'"),
    "matching_search_regex": _matching(f"{_ANY} AND regexp_matches(\"user\", '^[1-3].$', 'i')"),
    "matching_department": _matching(f"{_ANY} AND department = 'NATION_7'"),
    "threats_high": _page("severity IN ('High', 'Critical')", 5000),
    "threats_include_drift": _page("severity = 'Critical' OR drift_flag", 5000),
    "threats_normal": _page("true", 5000),
    "threats_search": _page(f"{_ANY} AND \"user\" ILIKE '%1%'", 5000),
    "threats_search_regex": _page(
        f"{_ANY} AND regexp_matches(\"user\", '^[1-3].$', 'i')", 5000
    ),
    "threats_department": _page(f"{_ANY} AND department = 'NATION_7'", 5000),
    "threats_total": f"{_SCORES} SELECT count(*) AS total_matching FROM scores WHERE {_ANY}",
    "threats_total_with_drift": f"{_SCORES} SELECT count(*) AS total_matching FROM scores "
    "WHERE severity = 'Critical' OR drift_flag",
    "top_threats": f"{_SCORES} SELECT {_PREVIEW} FROM scores WHERE {_ANY} {_RANKED} LIMIT 20",
    "top_days": f"{_SCORES} SELECT {_PREVIEW} FROM scores {_RANKED} LIMIT 10",
    "user_headers": f'{_HEADER} GROUP BY "user", f.role, f.department, f.team',
    "user_timeline": f"{_SCORES} SELECT {_RECORD} FROM scores WHERE \"user\" = '7'",
    "user_timeline_header": f"{_HEADER} WHERE \"user\" = '7' "
    'GROUP BY "user", f.role, f.department, f.team',
    "user_found": f"{_SCORES} SELECT 'no such user' AS user_id, count(*) > 0 AS found "
    "FROM scores WHERE \"user\" = 'no such user'",
    "flagged_history": f"{_SCORES} SELECT {_RECORD} FROM threat_base WHERE \"user\" = '7'",
    "display_reasons": f'{_SCORES} SELECT "user", {_DAY}, {_DISPLAY} FROM threat_base',
    "compact_threats": f"""{_SCORES} SELECT "user", {_DAY}, severity,
  CAST(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2
       WHEN 'Low' THEN 1 ELSE 0 END AS TINYINT) AS severity_rank,
  CAST(severity_score AS FLOAT) AS severity_score, CAST(logon_count AS FLOAT) AS logon_count
  FROM threat_base""",
    "serving_record": f"{_SCORES} SELECT {_RECORD} FROM scores",
    "serving_json": f'{_SCORES} SELECT "user", {_DAY}, severity, severity_score, reasons, '
    "CAST(logon_count AS DOUBLE) AS logon_count, drift_flag FROM scores",
    "serving_roundtrip": f"{_SCORES} SELECT {_RECORD} FROM scores",
    "serving_lookup": f"{_SCORES} SELECT {_RECORD} FROM scores WHERE \"user\" = '7'",
    "serving_lookup_bucketed": f"{_SCORES} SELECT {_RECORD} FROM scores WHERE \"user\" = '7'",
    "timeline_manifest": f"{_SCORES} SELECT {_RECORD} FROM scores WHERE \"user\" = '7'",
    "rescored_day": f"WITH {_EVENT_DAYS}, {_with_z('event_features')} "
    f'SELECT "user", {_DAY}, {_each("z_#")} FROM scored_z',
    "compact_with_stats": f"""{_SCORES} SELECT count(*) AS total_user_days,
  count(*) FILTER (severity <> 'Normal') AS total_flagged, {_BREAKDOWN},
  count(*) FILTER (drift_flag) AS drift_flagged,
  count(*) FILTER (severity = 'Normal' AND drift_flag) AS drift_only,
  strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day,
  count(*) FILTER (severity <> 'Normal' OR drift_flag) AS threats FROM scores""",
    "stored_search": _matching(f"{_ANY} AND \"user\" ILIKE '%1%'"),
    "source_guards": f"""{_SCORES} SELECT rows, "case", error FROM (SELECT count(*) AS rows FROM scores),
  (VALUES ('missing table', 'MissingSource'), ('limit 0', 'ValueError'), ('limit 5001', 'ValueError'),
          ('offset -1', 'ValueError'), ('limit 5000', '')) AS cases("case", error)""",
    "layout_totals": f"{_SCORES} SELECT count(*) AS rows, true AS fewest_groups, "
    "least(500, count(*)) AS largest_group FROM scores",
    "layout_buckets": f"{_SCORES} SELECT count(*) AS rows, 4 AS buckets FROM scores",
    "resolve_serving": _SUMMARY + " WHERE severity <> 'Low'",
    "resolve_scores": _SUMMARY,
    "preview_csv": f"{_SCORES} SELECT {_PREVIEW} FROM scores WHERE {_ANY} {_RANKED} LIMIT 20",
    "iforest_scores": f"""{("WITH " + _EVENT_DAYS).replace("WITH", "WITH RECURSIVE", 1)}, {_forest("event_features")}
SELECT "user", {_DAY}, {", ".join(FEATURES)}, iso_score_raw < 0 AS iso_anomaly,
  round(iso_score_raw, 9) AS iso_score_raw
FROM event_features d JOIN vector_scores v ON v.p = {_POINT}""",
    "iforest_threshold": f"""{("WITH " + _EVENT_DAYS).replace("WITH", "WITH RECURSIVE", 1)}, {_forest("event_features")}
SELECT n AS rows, low AS low_total, high AS high_total, round(fraction, 6) AS fraction FROM threshold""",
    "full_detection": f"{_DETECTED} SELECT {_RECORD} FROM scores",
    "stats_with_model": _STATS.replace(_SCORES, _DETECTED, 1),
    "run_summary_with_model": _SUMMARY.replace(_SCORES, _DETECTED, 1),
    "threats_page_with_model": _page(_ANY).replace(_SCORES, _DETECTED, 1),
    "top_threats_with_model": f"{_DETECTED} SELECT {_PREVIEW} FROM scores WHERE {_ANY} {_RANKED} LIMIT 20",
    "iforest_vectors": _events(
        f"SELECT {_each('CAST(# AS DOUBLE) AS #')}, count(*) AS rows "
        f"FROM event_features GROUP BY ALL"
    ),
    "client_keys": """WITH requests AS (
  SELECT CASE event_type WHEN 'view' THEN '198.51.100.' || user_id || ', 10.0.0.1, 10.0.0.2'
              WHEN 'click' THEN ' 198.51.100.' || user_id || ' ,10.0.0.1'
              WHEN 'purchase' THEN '' END AS forwarded_for,
         CASE WHEN event_type <> 'error' THEN '203.0.113.' || user_id END AS host
  FROM events)
SELECT CASE WHEN forwarded_for <> '' THEN trim(split_part(forwarded_for, ',', 1))
            ELSE coalesce(host, 'unknown') END AS client, count(*) AS requests
FROM requests GROUP BY 1""",
    "access_audit_report": _AUDIT,
    "access_audit_json": _AUDIT,
    "access_audit_stream": _AUDIT,
    "trailing_request_count": f"""WITH {_REQUESTS}
SELECT client, {_US.format("ts")}, requests,
  CAST(sum(requests) OVER (PARTITION BY client ORDER BY ts
       RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing
FROM seconds""",
    "throttle_decisions": _THROTTLE,
    "throttle_stream": _THROTTLE,
}
