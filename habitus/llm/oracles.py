"""SQL counterparts of the queries, where SQL can express them.

Without one: the tokenizer's ids (op1, op6), fitted models (op2, op10), iterated components over
MinHash or SimHash candidates (op5, op7) and the engine's own hash (op9). Those are tested against
brute force on small fixtures.
"""

from __future__ import annotations

from habitus.llm.centroids import DIMENSIONS, K, ROUNDS, SCALE, SEED
from habitus.llm.decontamination import MASKS, SHARE, WINDOW
from habitus.llm.pii import CONTEXT, CONTEXT_BONUS, CONTEXT_CHARS, KINDS, PRIOR
from habitus.llm.spelling import EVERY, LEAST_COUNT, LEAST_LENGTH, LETTERS, TIMES

# The patterns as the contract states them; for iban the word boundary is the ASCII one.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_CONFIRMED = {
    "email": "true",
    "ip": """len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3
        OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0""",
    "card": f"""length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(
        range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1
            THEN CAST(reverse({_DIGITS})[i] AS INT)
            ELSE (2 * CAST(reverse({_DIGITS})[i] AS INT)) // 10
               + (2 * CAST(reverse({_DIGITS})[i] AS INT)) % 10 END)) % 10 = 0""",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": """length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(
        list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''),
            lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END),
        lambda rest, d: (CASE WHEN d < 10 THEN rest * 10 ELSE rest * 100 END + d) % 97, 0) = 1""",
}


def _kind(number: int, kind: str) -> str:
    pattern = _PATTERNS[kind]
    return f"""
  SELECT r, {number} AS k, '{kind}' AS kind, b AS begin_, b + length(v) AS end_, v,
    round({PRIOR[kind]} + CASE WHEN regexp_matches(lower(right(gap, {CONTEXT_CHARS})),
      '(^|[^a-z])(?:{CONTEXT[kind]})([^a-z]|$)') THEN {CONTEXT_BONUS} ELSE 0 END, 2) AS score
  FROM (
    SELECT r, unnest(list_transform(range(1, len(vals) + 1), lambda i: struct_pack(
        v := vals[i], gap := gaps[i],
        b := CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) AS BIGINT)
           + CAST(coalesce(list_sum(list_transform(vals[1:i - 1], lambda x: length(x))), 0) AS BIGINT))),
      recursive := true)
    FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS vals,
            string_split_regex(text, '{pattern}') AS gaps FROM d WHERE regexp_matches(text, '{pattern}'))
  ) WHERE {_CONFIRMED[kind]}"""


_OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_kind(n, k) for n, k in enumerate(KINDS))}),
g AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
    string_agg(kind || ':' || begin_ || ':' || end_, ',' ORDER BY k, begin_) FILTER (k < 4) AS base,
    string_agg(kind || ':' || begin_ || ':' || end_, ',' ORDER BY k, begin_) AS spans,
    string_agg(CAST(CAST(score AS DOUBLE) AS VARCHAR), ',' ORDER BY k, begin_) AS scores
  FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (r)
"""

_OP4 = r"""
WITH c AS (
  SELECT row_number() OVER () AS r, page_id, url, 1704067200 + (page_id * 7919) % 31104000 AS "at",
    nullif(regexp_replace(regexp_extract(lower(url),
      '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', ''), '') AS host
  FROM pages),
v AS (
  SELECT 'host' AS scope, host AS value FROM c WHERE host IS NOT NULL
  UNION SELECT 'domain', nullif(regexp_extract(host, '^[^.]+\.(.+)$', 1), '') FROM c
  UNION SELECT 'url', lower(trim(url, ' ')) FROM c),
n AS (SELECT scope, value, CAST('0x' || substr(md5(value), 1, 6) AS BIGINT) AS k FROM v WHERE value IS NOT NULL),
e AS (
  SELECT CASE scope WHEN 'host' THEN 'block-hosts' ELSE 'block-domains' END AS list, scope, value,
    1704067200 + (k % 300) * 86400 AS since,
    CASE WHEN scope = 'domain' THEN 1704067200 + (k % 300 + 60) * 86400
         WHEN k % 2 = 0 THEN 1704067200 + (k % 300 + 90) * 86400 END AS until
  FROM n WHERE scope = 'host' AND k % 3 = 0 OR scope = 'domain' AND k % 4 = 0
  UNION ALL SELECT 'block-domains', scope, value, 1704067200 + (k % 300 + 120) * 86400, NULL
  FROM n WHERE scope = 'domain' AND k % 4 = 0
  UNION ALL SELECT 'allow-urls', scope, value, 1704067200 + (k % 300) * 86400, NULL
  FROM n WHERE scope = 'url' AND k % 50 = 0),
m AS (
  SELECT c.r, e.list, e.scope, e.value, e.since
  FROM c JOIN e ON c."at" >= e.since AND (e.until IS NULL OR c."at" < e.until) AND (
    e.scope = 'host' AND e.value = c.host
    OR e.scope = 'url' AND e.value = lower(trim(c.url, ' '))
    OR e.scope = 'domain' AND (e.value = c.host OR (ends_with(c.host, '.' || e.value) AND contains(e.value, '.')))))
SELECT any_value(c.page_id) AS page_id, any_value(c.url) AS url, any_value(c."at") AS "at",
  count(DISTINCT (m.list, m.scope, m.value)) FILTER (m.list IS NOT NULL) AS entries,
  coalesce(string_agg(DISTINCT m.list, ',' ORDER BY m.list), '') AS lists, min(m.since) AS since,
  CASE WHEN bool_or(m.list LIKE 'allow%') THEN 'allow' WHEN count(m.list) > 0 THEN 'block' ELSE 'pass' END AS verdict
FROM c LEFT JOIN m USING (r) GROUP BY r
"""


def _masked(mask: str, words: str, at: str) -> str:
    return " || ' ' || ".join(f"{words}[{at} + {k + 1}]" for k, c in enumerate(mask) if c == "1")


_SPAN = len(MASKS[0])
_OP8 = f"""
WITH i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w
  FROM benchmark),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w
  FROM documents),
ip AS (SELECT item_id, w, unnest(range(len(w))) AS p FROM i),
dp AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
ik AS (
  {" UNION ALL ".join(f"SELECT item_id, w, p, '{n}:' || {_masked(m, 'w', 'p')} AS key FROM ip WHERE p + {_SPAN} <= len(w)" for n, m in enumerate(MASKS))}
  UNION ALL SELECT item_id, w, 0, 'all:' || list_aggregate(w, 'string_agg', ' ') FROM i WHERE len(w) BETWEEN 1 AND {_SPAN - 1}),
dk AS (
  {" UNION ALL ".join(f"SELECT doc_id, w, p, '{n}:' || {_masked(m, 'w', 'p')} AS key FROM dp WHERE p + {_SPAN} <= len(w)" for n, m in enumerate(MASKS))}
  UNION ALL SELECT doc_id, w, p, 'all:' || list_aggregate(w[p + 1:p + n], 'string_agg', ' ')
  FROM dp, (SELECT DISTINCT len(w) AS n FROM i WHERE len(w) BETWEEN 1 AND {_SPAN - 1}) WHERE p + n <= len(w)),
h AS (
  SELECT doc_id, item_id, ik.w AS item, dk.w AS words, dk.p AS here, ik.p AS there,
    least({WINDOW}, len(ik.w)) AS size, least({_SPAN}, len(ik.w)) AS span
  FROM dk JOIN ik USING (key)),
v AS (SELECT *, unnest(range(greatest(0, there - (size - span)), least(there, len(item) - size) + 1)) AS head FROM h),
e AS (
  SELECT doc_id, item_id, size, greatest(0, here - there + head) AS doc_word,
    len(list_filter(range(size), lambda k: here - there + head + k >= 0
      AND coalesce(words[here - there + head + k + 1] = item[head + k + 1], false))) AS equal_words
  FROM v)
SELECT doc_id, item_id, b.size AS window_words, b.equal_words, -b.back AS doc_word FROM (
  SELECT doc_id, item_id, max(struct_pack(equal_words := CAST(equal_words AS BIGINT), size := CAST(size AS BIGINT),
    back := CAST(-doc_word AS BIGINT))) AS b
  FROM e WHERE equal_words >= ceil({SHARE} * size) GROUP BY doc_id, item_id)
"""

_OP11 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS bound,
    CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM d GROUP BY source),
-- Sources by the share at which they reach their bound: those before a source are at theirs.
l AS (
  SELECT *, (SELECT sum(size) FROM d) - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s),
f AS (SELECT rest, open_weight FROM l WHERE CAST(rest AS DOUBLE) * weight / open_weight <= bound ORDER BY bound / weight, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, coalesce(least(CAST(bound AS DOUBLE),
    CAST((SELECT rest FROM f) AS DOUBLE) * weight / (SELECT open_weight FROM f)), bound) AS target
  FROM s),
q AS (
  SELECT row_number() OVER () AS r, d.doc_id, d.source, d.key, d.size, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING) AS queue_end
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT r, size, sum(size) OVER (ORDER BY CAST((round - 1) * source_size + queue_end AS DOUBLE) / target, key,
    source NULLS FIRST, round ROWS UNBOUNDED PRECEDING) AS words
  FROM q, (VALUES (1), (2), (3)) AS rounds(round) WHERE size > 0 AND target > 0),
n AS (SELECT r, count(*) AS copies FROM c WHERE words <= (SELECT sum(size) FROM d) GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken,
  CAST(coalesce(copies, 0) AS INTEGER) AS copies, source
FROM q LEFT JOIN n USING (r)
"""

_OP12 = f"""
WITH RECURSIVE t AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, b:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
g AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM r WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
h AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(bytes) // 2),
    lambda k: CAST('0x' || substr(bytes, 2 * k + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h
  FROM g, t),
v AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM h)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
p AS (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM v),
e AS MATERIALIZED (SELECT word, n, i < length(word) AS skips, substr(word, 1, i) AS head, substr(word, i + 2) AS tail, substr(word, i + 1) AS rest FROM p),
a AS (
  SELECT x.word, y.word AS near FROM e x JOIN e y ON x.skips AND y.skips AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word
  UNION SELECT x.word, y.word FROM e x JOIN e y ON x.skips AND x.head = y.head AND x.tail = y.rest),
b AS (SELECT word, near FROM a UNION SELECT near, word FROM a),
m AS (
  SELECT b.word, count(*) AS n_near, min(struct_pack(less := -v.n, form := b.near)) AS best
  FROM b JOIN v ON v.word = b.near GROUP BY b.word),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {TIMES} * v.n THEN best.form END AS form,
    CASE WHEN -best.less >= {TIMES} * v.n THEN -best.less END AS form_n
  FROM v LEFT JOIN m USING (word)),
w AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, CAST(f.form_n AS BIGINT) AS form_n, w.root
FROM f JOIN (SELECT w.word, w.root FROM w JOIN f ON f.word = w.root WHERE f.form IS NULL) w ON w.word = f.word
"""


def _assign(round_: int) -> str:
    gap = "(k.v[i] - c.v[i])"
    return f"""
a{round_} AS MATERIALIZED (
  SELECT k.r, any_value(k.v) AS v, min(struct_pack(d := CAST(list_sum(list_transform(range(1, {DIMENSIONS + 1}),
    lambda i: {gap} * {gap})) AS BIGINT), c := c.c)) AS best
  FROM k, c{round_} c GROUP BY k.r)"""


def _move(round_: int) -> str:
    return f"""
c{round_ + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{round_} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT best.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
      FROM a{round_}, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i) GROUP BY best.c, i)
    GROUP BY c) m USING (c))"""


_OP13 = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT c, v FROM (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM k)
  WHERE c < {K}),
{",".join(_assign(n) + "," + _move(n) for n in range(ROUNDS))},
{_assign(ROUNDS)},
i AS (SELECT best.c AS c, CAST(sum(best.d) AS BIGINT) AS total FROM a{ROUNDS} GROUP BY best.c)
SELECT k.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, i.total AS cluster_inertia,
  (SELECT CAST(sum(total) AS BIGINT) FROM i) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN k USING (r) JOIN i ON i.c = a.best.c JOIN c{ROUNDS} c ON c.c = a.best.c
"""

ORACLES: dict[str, str] = {
    "op3_pii": _OP3,
    "op4_url_filters": _OP4,
    "op8_decontamination": _OP8,
    "op11_mixing": _OP11,
    "op12_spelling": _OP12,
    "op13_centroids": _OP13,
}
