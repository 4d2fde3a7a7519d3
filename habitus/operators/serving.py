"""What a reader asks of the scored table: totals, ranked pages, one actor's history."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, SERVED_COLUMNS, SEVERITIES, UNKNOWN, Settings
from habitus.functions.levels import is_drift_only, is_flagged, levels_from, rank_of
from habitus.functions.text import history_reason, table_reason
from habitus.functions.times import day_text

# Bounds of a page.
DEFAULT_LIMIT = 500
MAX_LIMIT = 5000

#: Actors, chosen by hash, whose names part the ranking into ranges.
BOUNDS = 255

_CONTEXT = ("role", "department", "team")

# The numbers kept in single precision for a resident table.
_NUMBERS = (
    "severity_score",
    "logon_count",
    "off_hours_logon_count",
    "distinct_pcs",
    "usb_connect_count",
    "off_hours_usb_count",
)


def serving_record(scores: DataFrame) -> DataFrame:
    """The served fields as a reader gets them, in one projection.

    Days become text, numbers doubles, and unknown context the word for it.
    """
    forms = (
        {name: "cast({0} as double)" for name in _NUMBERS}
        | {name: f"coalesce({{0}}, '{UNKNOWN}')" for name in _CONTEXT}
        | {"day": "date_format({0}, 'yyyy-MM-dd')"}
    )
    return scores.selectExpr(
        *[f"{forms.get(c, '{0}').format(f'`{c}`')} as `{c}`" for c in SERVED_COLUMNS]
    )


def as_json(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct(*SERVED_COLUMNS)).alias("record"))


def threat_base(scores: DataFrame) -> DataFrame:
    """All days a ranked page may show: flagged by severity, or drifting."""
    return scores.where(is_flagged(F.col("severity")) | F.col("drift_flag"))


def compact(threats: DataFrame) -> DataFrame:
    """Narrow types plus ``severity_rank``, for keeping the base set in memory.

    The numbers are small whole numbers, which single precision holds exactly.
    """
    return threats.withColumns(
        {name: F.col(name).cast("float") for name in _NUMBERS}
        | {"severity_rank": rank_of(F.col("severity"))}
    )


def _breakdown(severity: Column) -> list[Column]:
    """Rows per level, with a zero for a level that does not occur."""
    return [F.count_if(severity == name).alias(name.lower()) for name in SEVERITIES]


def severity_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("severity").agg(F.count(F.lit(1)).alias("user_days"))


def stats(scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row of totals over the whole table.

    ``drift_flagged`` counts all drifting days, ``drift_only`` those that are Normal.
    """
    severity, drift = F.col("severity"), F.col("drift_flag")
    return scores.agg(
        F.count_distinct(settings.actor).alias("total_users"),
        F.count(F.lit(1)).alias("total_user_days"),
        F.count_if(is_flagged(severity)).alias("total_flagged"),
        *_breakdown(severity),
        F.count_if(drift).alias("drift_flagged"),
        F.count_if(is_drift_only(severity, drift)).alias("drift_only"),
        day_text(F.min(settings.day)).alias("first_day"),
        day_text(F.max(settings.day)).alias("last_day"),
    )


def observed_totals(scores: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, Observation]:
    """``scores`` with the totals of ``stats``, but the number of actors, counted as rows pass by.

    The observation has them once an action has run over all rows. Keep them ahead of any shuffle, in
    the stage that writes, where each row is counted once also if a task is repeated.
    """
    severity, drift = F.col("severity"), F.col("drift_flag")
    seen = Observation()
    return scores.observe(
        seen,
        F.count(F.lit(1)).alias("total_user_days"),
        F.count_if(is_flagged(severity)).alias("total_flagged"),
        *_breakdown(severity),
        F.count_if(drift).alias("drift_flagged"),
        F.count_if(is_drift_only(severity, drift)).alias("drift_only"),
        day_text(F.min(settings.day)).alias("first_day"),
        day_text(F.max(settings.day)).alias("last_day"),
    ), seen


def write_compact(scores: DataFrame, path: str, settings: Settings = DEFAULTS) -> dict:
    """Write the compact base set of threats and return the totals of all rows, from one scan."""
    passing, seen = observed_totals(scores, settings)
    compact(threat_base(passing)).write.mode("overwrite").parquet(path)
    return seen.get


def stats_record(scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The totals with the breakdown as a map and the range as a struct."""
    by_level = [x for name in SEVERITIES for x in (F.lit(name), F.col(name.lower()))]
    return stats(scores, settings).select(
        "total_users",
        "total_user_days",
        "total_flagged",
        F.create_map(*by_level).alias("severity_breakdown"),
        "drift_flagged",
        F.struct(F.col("first_day").alias("start"), F.col("last_day").alias("end")).alias(
            "date_range"
        ),
    )


def run_summary(scores: DataFrame) -> DataFrame:
    """One row: days, flagged days, days only drift caught."""
    severity, drift = F.col("severity"), F.col("drift_flag")
    return scores.agg(
        F.count(F.lit(1)).alias("user_days"),
        F.count_if(is_flagged(severity)).alias("flagged"),
        F.count_if(is_drift_only(severity, drift)).alias("drift_only"),
    )


class ThreatPage(NamedTuple):
    total_matching: DataFrame
    limit: int
    offset: int
    results: DataFrame


def ranked(scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Highest score first; actor and day break ties so that pages never overlap."""
    return scores.orderBy(F.desc("severity_score"), settings.actor, settings.day)


def matching_threats(
    scores: DataFrame,
    min_severity: str = "Low",
    include_drift: bool = False,
    user: str | None = None,
    department: str | None = None,
    regex: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The flagged or drifting days that pass the filters, unordered.

    ``user`` is a case-insensitive substring, or with ``regex`` a pattern.
    ``include_drift`` adds drifting days of any severity. The filters are plain
    comparisons of stored columns, so they reach the Parquet scan.
    """
    wanted = F.col("severity").isin(*levels_from(min_severity))
    if include_drift:
        wanted = wanted | F.col("drift_flag")
    found = threat_base(scores).where(wanted)
    actor = F.col(settings.actor)
    if user and regex:
        found = found.where(actor.rlike(f"(?i){user}"))
    elif user:
        found = found.where(F.lower(actor).contains(user.lower()))
    if department:
        same = F.col("department") == department
        missing = F.col("department").isNull() & F.lit(department == UNKNOWN)
        found = found.where(same | missing)
    return found


def threats(
    scores: DataFrame,
    min_severity: str = "Low",
    include_drift: bool = False,
    user: str | None = None,
    department: str | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    regex: bool = False,
    settings: Settings = DEFAULTS,
) -> ThreatPage:
    """A page of the ranked threats and, apart from it, the number of all matches.

    The page is a top-k within the part of the ranking it lies in (``ranked_page``); the
    total is a plain count.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    found = matching_threats(
        scores, min_severity, include_drift, user, department, regex, settings
    )
    page = ranked_page(found, offset, limit, settings)
    total = found.agg(F.count(F.lit(1)).alias("total_matching"))
    return ThreatPage(total, limit, offset, serving_record(page))


def top_threats(scores: DataFrame, count: int = 20, settings: Settings = DEFAULTS) -> DataFrame:
    """The highest ranked flagged days."""
    return ranked(scores.where(is_flagged(F.col("severity"))), settings).limit(count)


def top_days(scores: DataFrame, count: int = 10, settings: Settings = DEFAULTS) -> DataFrame:
    """The highest ranked days, flagged or not."""
    return ranked(scores, settings).limit(count)


def user_headers(scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per actor: days, flagged days, days per level, any drift, context of day one.

    An actor's context hardly ever changes, so grouping by it first leaves about one row
    per actor for the step that picks the earliest. The large step then keeps no text in
    its buffers, which lets it hash instead of sort.
    """
    context = list(_CONTEXT)
    severity = F.col("severity")
    counts = [
        F.count(F.lit(1)).alias("total_days"),
        F.count_if(is_flagged(severity)).alias("flagged_days"),
        *_breakdown(severity),
    ]
    names = ["total_days", "flagged_days", *[name.lower() for name in SEVERITIES]]
    per_context = (
        scores.fillna(UNKNOWN, subset=context)
        .groupBy(settings.actor, *context)
        .agg(
            F.min(settings.day).alias("first_day"),
            F.max("drift_flag").alias("any_drift"),
            *counts,
        )
    )
    return (
        per_context.groupBy(settings.actor)
        .agg(
            F.min(F.struct("first_day", *context)).alias("first"),
            *[F.sum(name).alias(name) for name in names],
            F.bool_or("any_drift").alias("any_drift"),
        )
        .select(
            settings.actor, *[f"first.{name}" for name in context], *names, "any_drift"
        )
    )


def ranked_page(
    found: DataFrame, offset: int, limit: int, settings: Settings = DEFAULTS
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the ranking, whatever the offset.

    A top-k alone would hold ``offset`` rows in every task. The ranking is parted into
    cells by score and, within a score, by ranges of actors whose bounds are a bounded
    number of actor names. One pass counts the cells (scores are sums of a few weights,
    so they are few); the cells before the page are skipped, and only those it lies in
    are read and ranked. Bounds and scores enter both passes as literals, so the passes
    agree however often they run, and comparisons with them are pushed into the scan.
    Nothing is skipped on the first page, so it needs no counts.
    """
    if offset == 0:
        return ranked(found, settings).limit(limit)
    actor, score = F.col(settings.actor), F.col("severity_score")
    names = found.select(actor).where(actor.isNotNull()).distinct()
    bounds = [r[0] for r in names.orderBy(F.xxhash64(actor), actor).limit(BOUNDS).collect()]
    bounds.sort()
    place = F.lit(0)
    if bounds:
        place = F.size(F.filter(F.lit(bounds), lambda bound: bound <= actor))
    cell = F.when(actor.isNull(), -1).otherwise(place)
    sizes = found.groupBy("severity_score", cell.alias("cell")).count().collect()
    rank = lambda r: (r[0] is None, -(r[0] or 0), r[1])
    inside, before, skipped = F.lit(False), 0, 0
    for value, number, rows in sorted(map(tuple, sizes), key=rank):
        if before + rows <= offset:
            skipped = before + rows
        elif before < offset + limit:
            own = score.eqNullSafe(F.lit(value))
            if number < 0:
                own = own & actor.isNull()
            if number > 0:
                own = own & (actor >= F.lit(bounds[number - 1]))
            if 0 <= number < len(bounds):
                own = own & (actor < F.lit(bounds[number]))
            inside = inside | own
        before += rows
    return ranked(found.where(inside), settings).offset(offset - skipped).limit(limit)


def page_after(
    found: DataFrame,
    after: tuple,
    limit: int,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The page behind a row given by its (score, actor, day): a top-k without any offset."""
    score, actor, day = after
    here, name, date = F.col("severity_score"), F.col(settings.actor), F.col(settings.day)
    later = (here < score) | (
        (here == score) & ((name > actor) | ((name == actor) & (date > F.lit(day))))
    )
    return ranked(found.where(later), settings).limit(limit)


class Timeline(NamedTuple):
    header: DataFrame
    days: DataFrame


def user_days(scores: DataFrame, user: str, settings: Settings = DEFAULTS) -> DataFrame:
    return scores.where(F.col(settings.actor) == F.lit(user))


def user_timeline(
    scores: DataFrame, user: str, settings: Settings = DEFAULTS, one_task: bool = False
) -> Timeline:
    """Header and chronological days of one actor; both are empty for an unknown one.

    ``one_task`` reads and sorts the days in a single task without an exchange. That is
    the fastest for a frame narrowed to a few files (``tables.lookup``), and wrong for
    a scan of a large table.
    """
    days = user_days(scores, user, settings)
    ordered = _in_order(days, F.asc(settings.day), one_task)
    return Timeline(user_headers(days, settings), serving_record(ordered))


def _in_order(days: DataFrame, order: Column, one_task: bool = False) -> DataFrame:
    """One actor's days sorted in one partition: at most one row per calendar day.

    A global sort would first run the scan once more to sample its ranges.
    """
    single = days.coalesce(1) if one_task else days.repartition(1)
    return single.sortWithinPartitions(order)


def user_found(scores: DataFrame, user: str, settings: Settings = DEFAULTS) -> DataFrame:
    """One row that says whether the actor has any day."""
    return user_days(scores, user, settings).agg(
        F.lit(user).alias("user_id"), (F.count(F.lit(1)) > 0).alias("found")
    )


def flagged_history(scores: DataFrame, user: str, settings: Settings = DEFAULTS) -> DataFrame:
    """One actor's flagged or drifting days, latest first."""
    days = threat_base(user_days(scores, user, settings))
    return serving_record(_in_order(days, F.desc(settings.day)))


def with_display_reasons(scores: DataFrame) -> DataFrame:
    """Add the texts shown in the ranked table and in an actor's history."""
    severity, reasons = F.col("severity"), F.col("reasons")
    drift, drift_reasons = F.col("drift_flag"), F.col("drift_reasons")
    return scores.withColumns(
        {
            "table_reason": table_reason(reasons, drift, drift_reasons),
            "history_reason": history_reason(severity, reasons, drift, drift_reasons),
        }
    )
