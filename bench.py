"""Headline timings as one JSON line.

BENCH_SF_DIR is the folder of the sample tables, BENCH_CPUS the local cores. Every
figure is the median of three runs after one warm-up, over whole tables, with all
rows of the result computed. Stage tables are stored first, as the batch steps do.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from habitus import registry, samples
from habitus.operators import access, baseline, drift, forest, profile, search, serving
from habitus.plans import incremental
from habitus.plans.detection import detect, score_days
from habitus.sources import manifest, tables

RUNS = 3


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("habitus-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compute(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(step) -> float:
    step()
    seconds = []
    for _ in range(RUNS):
        start = time.perf_counter()
        step()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    work = tempfile.mkdtemp(prefix="habitus-bench-")
    paths = {name: f"{work}/{name}" for name in ("days", "scores", "serving", "bucketed", "actors", "moments")}

    tables.write_table(registry.shipping_features(spark, folder), paths["days"])
    days = spark.read.parquet(paths["days"])
    model = forest.fit_forest(days)
    tables.write_table(score_days(days, model), paths["scores"])
    tables.write_serving(spark.read.parquet(paths["scores"]), paths["serving"])
    tables.write_serving(spark.read.parquet(paths["scores"]), paths["bucketed"], buckets=64)
    scores = tables.read_served(spark, paths["scores"])
    served = tables.read_served(spark, paths["serving"])
    manifest.write_manifest(spark, paths["serving"])
    opened = manifest.ServedTable(spark, paths["serving"], scores.schema)
    tables.write_table(search.distinct_actors(scores), paths["actors"])
    actors = tables.read_table(spark, paths["actors"])
    cuts = registry.cuts(days, 20)[-2:]
    incremental.advance(spark, paths["moments"], days, cuts[0])
    requests = samples.client_requests(spark, folder)
    limit, window = registry.LIMIT, registry.WINDOW

    def timeline(path: str, buckets: int | None = None) -> list:
        """One actor's days; each layout is opened anew, with the schema a reader keeps."""
        days = tables.lookup(spark, path, "77", buckets=buckets, schema=scores.schema)
        return serving.user_timeline(days, "77", one_task=True).days.collect()

    steps = {
        "feature_table_events": lambda: compute(registry.event_features(spark, folder)),
        "feature_table_lineitem": lambda: compute(registry.shipping_features(spark, folder)),
        "feature_profile": lambda: compute(profile.describe(registry.event_features(spark, folder))),
        "zscores": lambda: compute(baseline.zscores(days)),
        "zscores_and_drift": lambda: compute(
            drift.drift_signal(baseline.zscores(days))
        ),
        "score_without_model": lambda: compute(score_days(days)),
        "forest_fit": lambda: forest.fit_forest(days),
        "forest_score": lambda: compute(model.transform(days)),
        "full_detection": lambda: compute(detect(days)),
        "write_serving": lambda: tables.write_serving(
            spark.read.parquet(paths["scores"]), f"{work}/serving-timed"
        ),
        "stats": lambda: serving.stats(served).collect(),
        "threats_page": lambda: serving.threats(served, "Medium").results.collect(),
        "threats_search": lambda: serving.threats(served, user="7").results.collect(),
        "user_headers": lambda: compute(serving.user_headers(served)),
        "timeline_unsorted": lambda: timeline(paths["scores"]),
        "timeline_clustered": lambda: timeline(paths["serving"]),
        "timeline_bucketed": lambda: timeline(paths["bucketed"], 64),
        "timeline_manifest": lambda: serving.user_timeline(opened.lookup("77"), "77", one_task=True).days.collect(),
        "search_stored": lambda: serving.serving_record(search.search_threats(served, actors, "77")).collect(),
        "baseline_next_slice": lambda: compute(incremental.next_moments(spark, paths["moments"], days, cuts[1])),
        "compact_with_totals": lambda: serving.write_compact(served, f"{work}/compact-timed"),
        "audit_report": lambda: compute(
            access.audit_report(access.audit_pairs(samples.accesses(spark, folder)))
        ),
        "trailing_requests": lambda: compute(access.trailing_request_count(requests, window)),
        "throttle": lambda: compute(access.throttle_decisions(requests, limit, window)),
    }
    seconds = {name: timed(step) for name, step in steps.items()}
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "user_days": days.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
