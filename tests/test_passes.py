"""Queries over small tables of their own: each scores the days once, and tasks stay small."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitus import registry, session
from habitus.config import DEFAULTS, FEATURES
from habitus.operators import baseline, drift
from habitus.sources import tables
from habitus.streaming import drift as live_drift

LINE = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Actors whose end is busier, one of them without a name; one has lines without a date."""
    path, rng = str(tmp_path_factory.mktemp("tables")), random.Random(7)
    lines = []
    for day in range(90):
        for actor in (1, 2, 3, 7, None):
            for k in range(rng.choice((1, 2, 3)) + 4 * (day > 70) + 9 * (day % 31 == 30)):
                flag, status = rng.choice("RNA"), rng.choice("OF")
                at = datetime(2020, 1, 1) + timedelta(days=day)
                lines.append((day, rng.randrange(9), actor, k, float(rng.randrange(50)), flag, status, at))
    lines += [(100, k, 3, k, 45.0, "R", "O", None) for k in range(8)]
    made = {
        "lineitem": (lines, LINE),
        "supplier": ([(n, f"S{n}", n % 2) for n in (1, 2, 3, 7)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(0, "N0", 0), (1, "N1", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R0")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def stored_as(df) -> set[str]:
    """Names of the tables a frame reads, without their numbers."""
    return {file.split("/")[-2].rsplit("-", 1)[0] for file in df.inputFiles()}


@pytest.mark.parametrize("offset", (3, 40))
def test_a_later_page_reads_the_stored_base_set(spark, folder, offset):
    found = registry._page(limit=5, offset=offset)(spark, folder)
    first = registry._page(limit=offset + 5)(spark, folder).collect()
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in first[offset:]]
    assert stored_as(found) <= {"threats"}


@pytest.mark.parametrize("name", ("resolve_serving", "timeline_manifest", "serving_roundtrip"))
def test_a_clustered_write_reads_stored_scores(spark, folder, name, monkeypatch):
    read, write = [], tables.write_serving
    monkeypatch.setattr(tables, "write_serving", lambda df, *a, **k: (read.append(df.inputFiles()), write(df, *a, **k)))
    assert registry.QUERIES[name](spark, folder).count() > 0
    assert read and not any("lineitem" in file or "actor-days" in file for files in read for file in files)


@pytest.mark.parametrize("name", ("drift_zscores", "drift_signal"))
def test_trailing_means_come_before_the_baseline(spark, folder, name):
    """The rows that are sorted have no columns of the baseline yet."""
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.index("Join") < plan.index("Window [")


def test_hashed_baselines_are_the_same(make_days):
    days = make_days({"u": [2] * 40 + [5] * 40, "v": [1], "w": [None, 3, 4]})
    assert sorted(map(str, baseline.zscores(days, hashed=True).collect())) == sorted(map(str, baseline.zscores(days).collect()))


def test_width_follows_the_rows(spark, monkeypatch):
    key = "spark.sql.shuffle.partitions"
    own = int(spark.conf.get(key))
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    with session.wide_enough(spark, 95):
        assert int(spark.conf.get(key)) == 10
    with session.wide_enough(spark, 5):
        assert int(spark.conf.get(key)) == own
    assert int(spark.conf.get(key)) == own
    df = spark.range(95).withColumn("user", F.col("id") % 40)
    assert session.parted(df, 95, "user").rdd.getNumPartitions() == 10
    assert session.parted(df, 5, "user") is df


@pytest.mark.parametrize("rows", (session.TASK_ROWS, 50))
def test_drift_of_a_stream_is_that_of_the_batch(spark, folder, rows, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", rows)
    names = ("drift_stream", "drift_signal")
    # Rows without a date come first in a batch and count for its windows, never in a stream; both baselines cover them.
    found, want = (registry.QUERIES[n](spark, folder).where("user is not null and day > '2020-01-20'") for n in names)
    assert want.where("drift_flag").count() > 0
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_actors_of_a_group_share_a_row_of_state(spark, tmp_path):
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "cp"))
    names = ", ".join(f"{f} long" for f in FEATURES)
    rows = [(f"u{a}", date(2020, 1, 1) + timedelta(days=d), *[(a * d) % 7] * 5) for a in range(30) for d in range(20)]
    days = spark.createDataFrame(rows, f"user string, day date, {names}")
    days.coalesce(1).write.parquet(source)
    with live_drift.list_state(spark):
        stream = live_drift.recent_means_stream(spark.readStream.schema(days.schema).parquet(source), groups=3)
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", kept)
        run = run.trigger(availableNow=True).start()
        run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    want = ["user", "day", *[f"recent_{f}" for f in FEATURES]]
    found = spark.read.parquet(out).select(want).collect()
    assert sorted(map(str, found)) == sorted(map(str, drift.recent_means(days).select(want).collect()))


class Kept:
    """A value state in memory."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_history_in_several_frames_and_odd_days():
    """Late days, missing days and missing counts of two actors in one group."""
    processor = live_drift.TrailingDays(DEFAULTS, T.StringType())
    processor.days = Kept()

    def frame(rows):
        made = [(user, None if d is None else date(2020, 1, 1) + timedelta(days=d), *[v] * 5, 1) for user, d, v in rows]
        return pd.DataFrame(made, columns=["user", "day", *FEATURES, live_drift.GROUP])

    processor.handleInitialState((1,), frame([("a", d, d) for d in range(8)] + [("b", 1, 1)]), None)
    processor.handleInitialState((1,), frame([("a", d, d) for d in range(8, 20)]), None)
    assert processor.days.value[0] == ["a"] * 13 + ["b"] and processor.days.value[1][-1] == 18263
    batch = frame([("a", 21, 5), ("b", 1, 9), ("a", 20, None), ("c", 3, 2), ("a", None, 4)])
    (found,) = processor.handleInputRows((1,), iter([batch[:2], batch[2:]]), None)
    assert found["late"].tolist() == [False, True, False, False, False]
    sums = [None if pd.isna(v) else v for v in found["_sum_logon_count"]]
    assert sums == [sum(range(8, 20)) + 5, None, sum(range(7, 20)), 2, sum(range(9, 20)) + 9]
    assert [None if pd.isna(v) else v for v in found["_rows_logon_count"]] == [13, None, 13, 1, 13]
    assert processor.days.value[0] == ["a"] * 13 + ["b", "c"]
