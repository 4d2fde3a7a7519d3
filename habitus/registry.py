"""Named queries over the sample tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus import samples
from habitus.config import DEFAULTS, FEATURES, PREVIEW_COLUMNS
from habitus.functions.clients import client_key
from habitus.functions.times import day_text
from habitus.operators import (
    access,
    baseline,
    drift,
    features,
    forest,
    moments,
    profile,
    rules,
    search,
    serving,
)
from habitus.operators.severity import final_severity, flatten_reasons
from habitus.plans import incremental
from habitus.plans.detection import detect, score_days
from habitus.session import cut_lineage, parted, scratch_path, wide_enough
from habitus.sources import logs, manifest, tables
from habitus.streaming import access as live
from habitus.streaming import drift as live_drift

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the access-log queries: three requests in six hours.
LIMIT, WINDOW = 3, 6 * 3600


def _text_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", day_text(F.col("day")))


def _stamp(name: str):
    """Text of a time whose format has whole seconds."""
    return F.substring(F.col(name).cast("string"), 1, 19).alias(name)


def _micros(name: str):
    """A time at full resolution, in any session zone."""
    return access.epoch_micros(F.col(name)).alias(f"{name}_us")


# ------------------------------------------------------------------ inputs


def event_features(spark: SparkSession, folder: str) -> DataFrame:
    return features.feature_table(
        samples.logon(spark, folder), samples.device(spark, folder), samples.users(spark, folder)
    )


def shipping_features(spark: SparkSession, folder: str) -> DataFrame:
    return features.with_context(
        samples.shipping_days(spark, folder), samples.suppliers(spark, folder)
    )


def shipping_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All detection steps but the model, whose outliers SQL cannot reproduce.

    The features are stored first, as ``detect`` does: the scores and the baseline each read them.
    """
    with wide_enough(spark, samples.table(spark, folder, "lineitem").count()):
        days = cut_lineage(shipping_features(spark, folder), "actor-days")
    return score_days(days)


def _stored_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The scores as a table, for steps that read them more than once: a clustered write samples its ranges."""
    return cut_lineage(shipping_scores(spark, folder).select(*DEFAULTS.served_columns), "scores")


def _served(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: query(shipping_scores(spark, folder))


# ------------------------------------------------------- sources and sinks


def load_summary(spark: SparkSession, folder: str) -> DataFrame:
    named = {"logon": samples.logon(spark, folder), "device": samples.device(spark, folder)}
    parts = [
        profile.load_summary(log).select(
            F.lit(name).alias("log"), "rows", _micros("first_date"), _micros("last_date")
        )
        for name, log in named.items()
    ]
    directory = profile.load_summary(samples.users(spark, folder).withColumn("date", F.lit(None)))
    blank = F.lit(None).cast("long")
    parts.append(
        directory.select(
            F.lit("users").alias("log"), "rows", blank.alias("first_date_us"), blank.alias("last_date_us")
        )
    )
    return reduce(DataFrame.unionByName, parts)


def csv_logon(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "logon-csv")
    logs.write_log_csv(samples.logon(spark, folder), path)
    return logs.scan_log(spark, path).select(_stamp("date"), "user", "pc", "activity")


def csv_device(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "device-csv")
    logs.write_log_csv(samples.device(spark, folder), path)
    return logs.scan_log(spark, path).select(_stamp("date"), "user", "pc", "activity")


def csv_users(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "users-csv")
    samples.users(spark, folder).write.option("header", True).csv(path)
    return logs.scan_users(spark, path).select(
        "user_id", "role", "department", "team", _stamp("start_date"), _stamp("end_date")
    )


def serving_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "serving")
    tables.write_serving(_stored_scores(spark, folder), path)
    return serving.serving_record(tables.read_served(spark, path))


def layout_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of several files, and whether each has as few row groups of at most 500 rows as possible."""
    path = scratch_path(spark, "serving")
    small = replace(DEFAULTS, row_group_rows=500)
    tables.write_serving(_stored_scores(spark, folder), path, small)
    report = tables.layout_report(spark, path).where("rows > 0")
    fewest = F.ceil(F.col("rows") / small.row_group_rows)
    return report.agg(
        F.sum("rows").alias("rows"), F.bool_and(F.col("row_groups") == fewest).alias("fewest_groups"),
        F.max("largest_group").alias("largest_group"),
    )


def layout_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each folder, each of which has whole actors, summed up from its files."""
    path = scratch_path(spark, "serving")
    tables.write_serving(_stored_scores(spark, folder), path, buckets=4)
    report = tables.layout_report(spark, path)
    parts = report.groupBy(F.regexp_extract("file", "=([0-9]+)/", 1).alias("bucket"))
    return parts.agg(F.sum("rows").alias("n")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("buckets")
    )


def resolve_scores(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "outputs")
    tables.write_table(shipping_scores(spark, folder), f"{path}/{tables.SCORE_TABLE}")
    return serving.run_summary(tables.resolve_scores(spark, path))


def resolve_serving(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables are there, with different rows: the clustered one is preferred."""
    path = scratch_path(spark, "outputs")
    fresh = shipping_scores(spark, folder)
    tables.write_table(fresh, f"{path}/{tables.SCORE_TABLE}")
    scores = tables.read_table(spark, f"{path}/{tables.SCORE_TABLE}", schema=fresh.schema)
    tables.write_serving(scores.where("severity <> 'Low'"), f"{path}/{tables.SERVING_TABLE}")
    return serving.run_summary(tables.resolve_scores(spark, path))


def serving_lookup(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "serving")
    tables.write_serving(_stored_scores(spark, folder), path)
    return serving.serving_record(tables.lookup(spark, path, "7"))


def serving_lookup_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "serving")
    tables.write_serving(_stored_scores(spark, folder), path, buckets=16)
    days = tables.lookup(spark, path, "7", buckets=16)
    return serving.user_timeline(days, "7", one_task=True).days


def timeline_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A lookup that opens the files the manifest names."""
    path = scratch_path(spark, "serving")
    tables.write_serving(_stored_scores(spark, folder), path)
    manifest.write_manifest(spark, path)
    served = manifest.ServedTable(spark, path, tables.read_served(spark, path).schema)
    return serving.user_timeline(served.lookup("7"), "7", one_task=True).days


def rescored_day(spark: SparkSession, folder: str) -> DataFrame:
    """All days are written, one with scores that are missing; that day is then scored and rewritten."""
    path = scratch_path(spark, "days")
    scored = baseline.zscores(event_features(spark, folder)).select(*_z_columns(("z",)))
    scored = cut_lineage(scored, "scored")
    last = scored.agg(F.max("day")).first()[0]
    stale = {f"z_{f}": F.when(F.col("day") < F.lit(last), F.col(f"z_{f}")) for f in FEATURES}
    tables.write_days(scored.withColumns(stale), path)
    tables.write_days(scored.where(F.col("day") == F.lit(last)), path)
    return _text_day(tables.read_table(spark, path, schema=scored.schema))


def compact_with_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of all rows, and the rows of the base set that the same scan wrote."""
    path, stored = scratch_path(spark, "compact"), scratch_path(spark, "scores")
    shipping_scores(spark, folder).write.parquet(stored)
    totals = serving.write_compact(tables.read_served(spark, stored), path)
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("threats"))
    return written.select(*[F.lit(value).alias(name) for name, value in totals.items()], "threats")


def stored_search(spark: SparkSession, folder: str) -> DataFrame:
    """A search by part of the name, through the stored table of actors."""
    stored, path = scratch_path(spark, "scores"), scratch_path(spark, "actors")
    shipping_scores(spark, folder).write.parquet(stored)
    scores = tables.read_served(spark, stored)
    search.distinct_actors(scores).write.parquet(path)
    return serving.serving_record(search.search_threats(scores, spark.read.parquet(path), "1"))


def csv_logon_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """A log in which lines of one machine have no date: good rows, and the text of the others."""
    path = scratch_path(spark, "logon-csv")
    broken = samples.logon(spark, folder).withColumn("at", F.date_format("date", "M/d/yyyy HH:mm:ss"))
    broken = broken.withColumn("at", F.when((F.col("pc") == "3") & (F.col("activity") == "Logoff"), "n/a").otherwise(F.col("at")))
    broken.select(F.col("at").alias("date"), "user", "pc", "activity").write.option("header", True).csv(path)
    scan = logs.scan_log_parts(spark, path)
    blank = F.lit(None).cast("string")
    good = scan.rows.select(_stamp("date"), "user", "pc", "activity", blank.alias("line"), blank.alias("file_kind"))
    kind = F.regexp_extract("file", r"\.([a-z]+)$", 1).alias("file_kind")
    wrong = scan.rejects.select(*[blank.alias(n) for n in ("date", "user", "pc", "activity")], "line", kind)
    return good.unionByName(wrong)


def source_guards(spark: SparkSession, folder: str) -> DataFrame:
    """The errors that guard a reader, by name: a table that is missing, a page out of bounds."""
    scores = shipping_scores(spark, folder)

    def error(step: Callable[[], object]) -> str:
        try:
            step()
        except (ValueError, FileNotFoundError) as found:
            return type(found).__name__
        return ""

    cases = {
        "missing table": lambda: tables.read_table(spark, f"{folder}/no-such-table"),
        "limit 0": lambda: serving.threats(scores, limit=0),
        "limit 5001": lambda: serving.threats(scores, limit=serving.MAX_LIMIT + 1),
        "offset -1": lambda: serving.threats(scores, offset=-1),
        "limit 5000": lambda: serving.threats(scores, limit=serving.MAX_LIMIT),
    }
    found = F.array(*[F.struct(F.lit(name).alias("case"), F.lit(error(step)).alias("error")) for name, step in cases.items()])
    return scores.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(found))


def preview_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "preview")
    tables.write_preview(serving.top_threats(shipping_scores(spark, folder)), path)
    schema = (
        "user string, day string, severity string, severity_score double, role string, "
        "department string, reasons string"
    )
    return spark.read.schema(schema).option("header", True).csv(path).select(*PREVIEW_COLUMNS)


# ---------------------------------------------------------------- features


def logon_features(spark: SparkSession, folder: str) -> DataFrame:
    return _text_day(features.logon_features(samples.logon(spark, folder)))


def device_features(spark: SparkSession, folder: str) -> DataFrame:
    return _text_day(features.device_features(samples.device(spark, folder)))


def merged_features(spark: SparkSession, folder: str) -> DataFrame:
    return _text_day(
        features.merge_features(
            features.logon_features(samples.logon(spark, folder)),
            features.device_features(samples.device(spark, folder)),
        )
    )


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return _text_day(event_features(spark, folder))


def feature_summary(spark: SparkSession, folder: str) -> DataFrame:
    return profile.feature_summary(event_features(spark, folder))


def feature_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.describe(event_features(spark, folder))


def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _text_day(profile.sample_rows(event_features(spark, folder)))


def repeated_users(spark: SparkSession, folder: str) -> DataFrame:
    """Segment and nation as the key, which customers do share."""
    people = samples.table(spark, folder, "customer")
    shared = F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"))
    return features.repeated_users(people.select(shared.alias("user_id")))


# ------------------------------------------------------ baseline and rules


def _z_columns(kinds: tuple[str, ...]) -> list[str]:
    return ["user", "day", *[f"{kind}_{f}" for kind in kinds for f in FEATURES]]


def cuts(days: DataFrame, parts: int) -> list[date]:
    """The last days of equal stretches of time."""
    low, high = days.agg(F.min("day"), F.max("day")).first()
    return [low + (high - low) * k // parts for k in range(1, parts + 1)]


def _stored_days(spark: SparkSession, folder: str, name: str = "days") -> DataFrame:
    path = scratch_path(spark, name)
    with wide_enough(spark, samples.table(spark, folder, "lineitem").count()):
        samples.shipping_days(spark, folder).write.parquet(path)
    return spark.read.parquet(path)


def _folded(spark: SparkSession, days: DataFrame) -> DataFrame:
    """The moments after five slices, each added by a run of its own."""
    path = scratch_path(spark, "moments")
    for until in cuts(days, 5):
        found = incremental.advance(spark, path, days, until)
    return found


def baseline_merged(spark: SparkSession, folder: str) -> DataFrame:
    return moments.baseline_of(_folded(spark, _stored_days(spark, folder)))


def zscores_merged(spark: SparkSession, folder: str) -> DataFrame:
    days = _stored_days(spark, folder)
    scored = moments.zscores_with(days, _folded(spark, days))
    return _text_day(scored.select(*_z_columns(("z", "mean", "std"))))


def actor_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return baseline.actor_baseline(samples.shipping_days(spark, folder))


def zscores(spark: SparkSession, folder: str) -> DataFrame:
    days = samples.shipping_days(spark, folder)
    return _text_day(baseline.zscores(days).select(*_z_columns(("z", "mean", "std"))))


def zscores_events(spark: SparkSession, folder: str) -> DataFrame:
    days = event_features(spark, folder)
    return _text_day(baseline.zscores(days).select(*_z_columns(("z",))))


def _ruled(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_scores(baseline.zscores(samples.shipping_days(spark, folder)))


def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _text_day(_ruled(spark, folder).select("user", "day", "rule_score"))


def rule_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _text_day(
        flatten_reasons(_ruled(spark, folder)).select("user", "day", "rule_score", "reasons")
    )


def rule_reasons_without_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Only z-scores are known: no counterfactual."""
    scored = baseline.zscores(event_features(spark, folder)).select(*_z_columns(("z",)))
    reasons = flatten_reasons(rules.rule_scores(scored))
    return _text_day(reasons.select("user", "day", "rule_score", "reasons"))


def counterfactual_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    days = rules.ceilings(baseline.zscores(samples.shipping_days(spark, folder)))
    return _text_day(days.select(*_z_columns(("ceiling",))))


def severity(spark: SparkSession, folder: str) -> DataFrame:
    """A simple rule stands in for the model, so that SQL can follow the bonus."""
    outlier = (F.col("off_hours_usb_count") >= 3) | (F.col("logon_count") >= 5)
    ruled = _ruled(spark, folder).withColumn("iso_anomaly", outlier)
    with_reason = ruled.withColumn(
        "reasons", forest.with_model_sentence(F.col("reasons"), F.col("iso_anomaly"))
    )
    return _text_day(
        flatten_reasons(final_severity(with_reason)).select(
            "user", "day", "severity_score", "severity", "reasons"
        )
    )


# ------------------------------------------------------------------- drift


def _trailing_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing means while the rows are narrow, then the baseline, as ``score_days`` has them."""
    days = _stored_days(spark, folder)
    return baseline.zscores(drift.recent_means(parted(days, days.count(), "user")), hashed=True)


def drift_zscores(spark: SparkSession, folder: str) -> DataFrame:
    scored = _trailing_scores(spark, folder)
    return _text_day(drift.drift_zscores(scored).select(*_z_columns(("recent", "drift_z"))))


def drift_signal(spark: SparkSession, folder: str) -> DataFrame:
    scored = _trailing_scores(spark, folder)
    return _text_day(
        drift.drift_signal(scored).select("user", "day", "drift_flag", "drift_reasons")
    )


def drift_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The first third of the days is history; the others arrive in four slices, a batch each.

    The stream is stopped after each slice and goes on from its checkpoint. It carries the features
    only; the baseline joins what it found.
    """
    source, out, kept = (scratch_path(spark, name) for name in ("day-files", "recent", "stream"))
    days = _stored_days(spark, folder, "z-days")
    rows = days.count()
    ends = cuts(days, 6)[1:]
    history = parted(days.where(F.col("day") <= F.lit(ends[0])), rows, "user")
    with live_drift.list_state(spark), wide_enough(spark, rows):
        for after, until in zip(ends[:-1], ends[1:], strict=True):
            incremental.days_between(days, after, until).write.mode("append").parquet(source)
            stream = spark.readStream.schema(days.schema).parquet(source)
            run = (
                live_drift.recent_means_stream(stream, live_drift.last_days(history))
                .writeStream.format("parquet").option("path", out)
                .option("checkpointLocation", kept)
            )
            run.trigger(availableNow=True).start().awaitTermination()
    recent = drift.recent_means(history).unionByName(spark.read.parquet(out).drop("late"))
    scored = baseline.zscores(recent, hashed=True, history=days)
    return _text_day(drift.drift_signal(scored).select("user", "day", "drift_flag", "drift_reasons"))


def drift_only(scores: DataFrame) -> DataFrame:
    return _text_day(
        scores.where((F.col("severity") == "Normal") & F.col("drift_flag")).select(
            "user", "day", "severity", "drift_reasons"
        )
    )


# ------------------------------------------------------------------- model


def iforest_scores(spark: SparkSession, folder: str) -> DataFrame:
    days = event_features(spark, folder)
    scored = forest.isolation_forest_score(days)
    raw = F.round("iso_score_raw", 9).alias("iso_score_raw")
    return _text_day(scored.select("user", "day", *FEATURES, "iso_anomaly", raw))


def iforest_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The path totals that the contamination quantile lies between, and its place."""
    model = forest.fit_forest(event_features(spark, folder))
    row = (model.quantile_low, model.quantile_high, round(model.quantile_fraction, 6))
    scored = event_features(spark, folder).agg(F.count(F.lit(1)).alias("rows"))
    return scored.select("rows", *[F.lit(v).alias(n) for v, n in zip(row, ("low_total", "high_total", "fraction"))])


def iforest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return forest.vector_counts(event_features(spark, folder))


def detected_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All detection steps, the model included."""
    return detect(shipping_features(spark, folder))


def full_detection(spark: SparkSession, folder: str) -> DataFrame:
    return serving.serving_record(detected_scores(spark, folder))


def _detected(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: query(detected_scores(spark, folder))


# ------------------------------------------------------------------ access


def client_keys(spark: SparkSession, folder: str) -> DataFrame:
    key = client_key(F.col("forwarded_for"), F.col("host"))
    return (
        samples.requests(spark, folder)
        .groupBy(key.alias("client"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def _report(pairs: DataFrame) -> DataFrame:
    return access.audit_report(pairs).select(
        "accessor",
        "lookups",
        "distinct_users",
        "not_found_share",
        _stamp("first_access"),
        _stamp("last_access"),
    )


def access_audit_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(access.audit_pairs(samples.accesses(spark, folder)))


def access_audit_json(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "audit")
    samples.audit_lines(spark, folder).write.json(path)
    return _report(access.audit_pairs(access.read_audit(spark, path)))


def access_audit_stream(spark: SparkSession, folder: str) -> DataFrame:
    lines, pairs = scratch_path(spark, "audit"), scratch_path(spark, "pairs")
    samples.audit_lines(spark, folder).repartition(20).write.json(lines)
    run = live.write_audit_pairs(
        live.stream_audit(spark, lines, files_per_batch=1), pairs, scratch_path(spark, "stream")
    )
    run.trigger(availableNow=True).start().awaitTermination()
    return _report(live.read_audit_pairs(spark, pairs))


def trailing_request_count(spark: SparkSession, folder: str) -> DataFrame:
    counted = access.trailing_request_count(samples.client_requests(spark, folder), WINDOW)
    return counted.select("client", _micros("ts"), "requests", "trailing")


def _decided(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "client", _micros("ts"), "requests", "admitted", "refused", "retry_after"
    )


def throttle_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(
        access.throttle_decisions(samples.client_requests(spark, folder), LIMIT, WINDOW)
    )


def throttle_stream(spark: SparkSession, folder: str) -> DataFrame:
    source, out = scratch_path(spark, "requests"), scratch_path(spark, "decisions")
    samples.client_requests(spark, folder).write.parquet(source)
    stream = spark.readStream.schema("client string, ts timestamp_ntz").parquet(source)
    run = (
        live.throttle_stream(stream, LIMIT, WINDOW)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "stream"))
    )
    run.trigger(availableNow=True).start().awaitTermination()
    return _decided(spark.read.parquet(out))


# ----------------------------------------------------------------- reading


def _stored_threats(scores: DataFrame) -> DataFrame:
    """The base set as a table: a page behind the first is counted before it is read."""
    return cut_lineage(serving.threat_base(scores).select(*DEFAULTS.served_columns), "threats")


def _page(**options) -> Query:
    if options.get("offset"):
        return _served(lambda scores: serving.threats(_stored_threats(scores), **options).results)
    return _served(lambda scores: serving.threats(scores, **options).results)


def _total(**options) -> Query:
    return _served(lambda scores: serving.threats(scores, **options).total_matching)


def _page_after(scores: DataFrame) -> DataFrame:
    """The second page of a hundred, asked for by the last row of the first."""
    found = serving.matching_threats(_stored_threats(scores))
    last = serving.ranked(found).limit(100).select("severity_score", "user", "day").tail(1)
    return serving.serving_record(serving.page_after(found, tuple(last[0]), 100))


def _matching(**options) -> Query:
    """All rows of a filter, without a page."""
    return _served(lambda scores: serving.serving_record(serving.matching_threats(scores, **options)))


def _display(scores: DataFrame) -> DataFrame:
    shown = serving.with_display_reasons(serving.threat_base(scores))
    return _text_day(shown.select("user", "day", "table_reason", "history_reason"))


def _compact(scores: DataFrame) -> DataFrame:
    return _text_day(
        serving.compact(serving.threat_base(scores)).select(
            "user", "day", "severity", "severity_rank", "severity_score", "logon_count"
        )
    )


def _json(scores: DataFrame) -> DataFrame:
    """A record as text and back."""
    text = serving.as_json(serving.serving_record(scores))
    schema = (
        "user string, day string, severity string, severity_score double, reasons string, "
        "logon_count double, drift_flag boolean"
    )
    return text.select(F.from_json("record", schema).alias("r")).select("r.*")


def _stats_long(scores: DataFrame) -> DataFrame:
    record = serving.stats_record(scores)
    return record.select(
        "total_user_days", F.explode("severity_breakdown").alias("severity", "user_days"), "date_range.*"
    )


QUERIES: dict[str, Query] = {
    "load_summary": load_summary,
    "csv_logon": csv_logon,
    "csv_logon_rejects": csv_logon_rejects,
    "csv_device": csv_device,
    "csv_users": csv_users,
    "logon_features": logon_features,
    "device_features": device_features,
    "merged_features": merged_features,
    "feature_table": feature_table,
    "feature_summary": feature_summary,
    "feature_profile": feature_profile,
    "sample_rows": sample_rows,
    "repeated_users": repeated_users,
    "actor_baseline": actor_baseline,
    "baseline_merged": baseline_merged,
    "zscores": zscores,
    "zscores_merged": zscores_merged,
    "zscores_events": zscores_events,
    "rule_scores": rule_scores,
    "rule_reasons": rule_reasons,
    "rule_reasons_without_baseline": rule_reasons_without_baseline,
    "counterfactual_ceiling": counterfactual_ceiling,
    "severity": severity,
    "drift_zscores": drift_zscores,
    "drift_signal": drift_signal,
    "drift_stream": drift_stream,
    "drift_only": _served(drift_only),
    "severity_breakdown": _served(serving.severity_counts),
    "stats": _served(serving.stats),
    "stats_record": _served(_stats_long),
    "run_summary": _served(serving.run_summary),
    "threats_page": _page(),
    "threats_second_page": _page(limit=100, offset=100),
    "threats_deep_page": _page(limit=500, offset=2000),
    "threats_page_after": _served(_page_after),
    "matching_high": _matching(min_severity="High"),
    "matching_include_drift": _matching(min_severity="Critical", include_drift=True),
    "matching_normal": _matching(min_severity="Normal"),
    "matching_search": _matching(user="1"),
    "matching_search_regex": _matching(user="^[1-3].$", regex=True),
    "matching_department": _matching(department="NATION_7"),
    "threats_high": _page(min_severity="High", limit=5000),
    "threats_include_drift": _page(min_severity="Critical", include_drift=True, limit=5000),
    "threats_normal": _page(min_severity="Normal", limit=5000),
    "threats_search": _page(user="1", limit=5000),
    "threats_search_regex": _page(user="^[1-3].$", regex=True, limit=5000),
    "threats_department": _page(department="NATION_7", limit=5000),
    "threats_total": _total(),
    "threats_total_with_drift": _total(min_severity="Critical", include_drift=True),
    "top_threats": _served(
        lambda scores: _text_day(serving.top_threats(scores).select(*PREVIEW_COLUMNS))
    ),
    "top_days": _served(
        lambda scores: _text_day(serving.top_days(scores).select(*PREVIEW_COLUMNS))
    ),
    "user_headers": _served(serving.user_headers),
    "user_timeline": _served(lambda scores: serving.user_timeline(scores, "7").days),
    "user_timeline_header": _served(lambda scores: serving.user_timeline(scores, "7").header),
    "user_found": _served(lambda scores: serving.user_found(scores, "no such user")),
    "flagged_history": _served(lambda scores: serving.flagged_history(scores, "7")),
    "display_reasons": _served(_display),
    "compact_threats": _served(_compact),
    "serving_record": _served(serving.serving_record),
    "serving_json": _served(_json),
    "serving_roundtrip": serving_roundtrip,
    "serving_lookup": serving_lookup,
    "serving_lookup_bucketed": serving_lookup_bucketed,
    "timeline_manifest": timeline_manifest,
    "rescored_day": rescored_day,
    "compact_with_stats": compact_with_stats,
    "stored_search": stored_search,
    "source_guards": source_guards,
    "layout_totals": layout_totals,
    "layout_buckets": layout_buckets,
    "resolve_scores": resolve_scores,
    "resolve_serving": resolve_serving,
    "preview_csv": preview_csv,
    "iforest_vectors": iforest_vectors,
    "iforest_scores": iforest_scores,
    "iforest_threshold": iforest_threshold,
    "full_detection": full_detection,
    "stats_with_model": _detected(serving.stats),
    "run_summary_with_model": _detected(serving.run_summary),
    "threats_page_with_model": _detected(lambda scores: serving.threats(scores).results),
    "top_threats_with_model": _detected(
        lambda scores: _text_day(serving.top_threats(scores).select(*PREVIEW_COLUMNS))
    ),
    "client_keys": client_keys,
    "access_audit_report": access_audit_report,
    "access_audit_json": access_audit_json,
    "access_audit_stream": access_audit_stream,
    "trailing_request_count": trailing_request_count,
    "throttle_decisions": throttle_decisions,
    "throttle_stream": throttle_stream,
}
