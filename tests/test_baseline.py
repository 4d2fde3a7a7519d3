from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from habitus.config import FEATURES
from habitus.operators.baseline import actor_baseline, zscores
from habitus.plans.detection import score_days

BOTH = pytest.mark.parametrize("score", [zscores, score_days])


@BOTH
def test_baseline_is_per_actor(make_days, score):
    quiet = [2] * 9 + [20]
    busy = [19, 20, 21, 20, 19, 21, 20, 19, 21, 20]
    df = score(make_days({"quiet": quiet, "busy": busy}))
    top = {r.user: r.z for r in df.groupBy("user").agg(F.max("z_logon_count").alias("z")).collect()}
    assert top["quiet"] > 2.5 > top["busy"]


@BOTH
def test_no_variation_scores_zero_and_has_no_spread(make_days, score):
    rows = score(make_days({"flat": [5] * 10})).collect()
    assert all(r.z_logon_count == 0 and r.std_logon_count is None for r in rows)


@BOTH
def test_mean_and_sample_deviation_are_kept(make_days, score):
    values = [2, 4, 6, 8, 10]
    row = score(make_days({"u": values})).first()
    assert row.mean_logon_count == 6.0
    assert row.std_logon_count == pytest.approx(statistics.stdev(values), abs=1e-12)
    assert all(hasattr(row, f"z_{f}") for f in FEATURES)


@BOTH
def test_single_day(make_days, score):
    row = score(make_days({"solo": [99]})).first()
    assert (row.z_logon_count, row.mean_logon_count, row.std_logon_count) == (0, 99, None)


@BOTH
def test_row_without_actor_has_no_baseline(spark, make_days, score):
    df = make_days({"u": [1, 2, 3]}).withColumn("user", F.expr("if(day = '2020-01-02', null, user)"))
    row = score(df).where("user is null").first()
    assert (row.z_logon_count, row.mean_logon_count, row.std_logon_count) == (0, None, None)


@BOTH
def test_fractional_features_use_the_general_path(make_days, score):
    values = [0.5, 1.5, 4.0]
    row = score(make_days({"u": values}, kind="double")).orderBy("day").first()
    assert row.std_logon_count == pytest.approx(statistics.stdev(values))
    assert row.z_logon_count == pytest.approx((0.5 - 2.0) / statistics.stdev(values))


@BOTH
def test_counts_of_billions_do_not_overflow(make_days, score):
    values = [4_000_000_000 + i for i in (0, 2, 4)]
    row = score(make_days({"u": values})).orderBy("day").first()
    assert row.std_logon_count == 2.0 and row.z_logon_count == -1.0


def test_both_ways_agree_bit_for_bit_under_any_partitioning(make_days):
    series = {f"u{i}": [(i * 7 + k * k) % 11 for k in range(40)] for i in range(20)}
    days = make_days(series)
    names = ["user", "day", *[f"{k}_{f}" for k in ("z", "mean", "std") for f in FEATURES]]
    results = [
        sorted(map(str, df.select(*names).collect()))
        for df in (
            zscores(days.coalesce(1)),
            zscores(days.repartition(8)),
            score_days(days.coalesce(1)),
            score_days(days.orderBy(F.rand(1)).repartition(8)),
        )
    ]
    assert all(r == results[0] for r in results)


def test_baseline_has_one_row_per_actor(make_days):
    assert actor_baseline(make_days({"a": [1, 2], "b": [3]})).count() == 2
