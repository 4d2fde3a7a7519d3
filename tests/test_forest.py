from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitus.config import FEATURES, Settings
from habitus.operators import forest

SMALL = Settings(trees=40, subsample=64)


@pytest.fixture(scope="module")
def days(spark):
    """A thousand ordinary rows, a few of them repeated a lot, and one extreme one."""
    ordinary = spark.range(1000).selectExpr(
        "concat('u', id % 20) as user",
        "date_add(date'2020-01-01', cast(id div 20 as int)) as day",
        "2 + pmod(xxhash64(id), 4) as logon_count",
        "if(pmod(xxhash64(id, 1), 20) = 0, 1L, 0L) as off_hours_logon_count",
        "1 + pmod(xxhash64(id, 2), 2) as distinct_pcs",
        "pmod(xxhash64(id, 3), 3) as usb_connect_count",
        "if(pmod(xxhash64(id, 4), 30) = 0, 1L, 0L) as off_hours_usb_count",
    )
    extreme = spark.sql(
        "select 'odd' as user, date'2020-01-01' as day, 60L as logon_count, "
        "40L as off_hours_logon_count, 30L as distinct_pcs, 50L as usb_connect_count, "
        "45L as off_hours_usb_count"
    )
    return ordinary.unionByName(extreme)


@pytest.fixture(scope="module")
def model(days):
    return forest.fit_forest(days, SMALL)


@pytest.fixture(scope="module")
def scored(days, model):
    return model.transform(days).collect()


def test_average_path_of_the_paper():
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    assert forest.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def walk(points, feature, threshold, value):
    """Path length of one point in one tree, slot by slot."""
    slot = 0
    while slot < len(feature):
        slot = 2 * slot + (2 if points[feature[slot]] > threshold[slot] else 1)
    return value[slot - len(feature)]


def test_a_tree_isolates_its_sample():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 50, size=(64, 5)).astype(float)
    feature, threshold, value = forest.grow_tree(points, 6, forest.split_draws(2, 0))
    assert len(feature) == 63 and len(value) == 64
    leaves = Counter()
    for point in points:
        slot = 0
        while slot < 63:
            slot = 2 * slot + (2 if point[feature[slot]] > threshold[slot] else 1)
        leaves[slot] += 1
    assert sum(leaves.values()) == 64
    one = forest.path_totals(points, feature[None], threshold[None], value[None])
    assert list(one) == [walk(p, feature, threshold, value) for p in points]


def test_leaf_values_are_depth_plus_the_expected_rest():
    points = np.array([[0.0], [0.0], [0.0], [10.0]])
    feature, threshold, value = forest.grow_tree(points, 2, lambda slot: (0, 0.5))
    lone = forest.path_totals(np.array([[10.0]]), feature[None], threshold[None], value[None])
    rest = forest.path_totals(np.array([[0.0]]), feature[None], threshold[None], value[None])
    step = 1 << 24
    assert lone[0] == step
    assert rest[0] == pytest.approx((1 + forest.average_path(3)) * step, abs=1)


def test_batches_do_not_change_a_total(model):
    points = np.random.default_rng(3).integers(0, 60, size=(500, 5)).astype(float)
    arrays = (model.feature, model.threshold, model.value)
    whole = forest.path_totals(points, *arrays)
    single = [forest.path_totals(p[None], *arrays)[0] for p in points[:50]]
    assert list(whole[:50]) == single
    assert [
        sum(walk(p, *tree) for tree in zip(*arrays)) for p in points[:20]
    ] == list(whole[:20])


def test_the_quantile_is_exact(scored):
    raw = sorted(r.iso_score_raw for r in scored)
    assert np.percentile(raw, 2) == pytest.approx(0.0, abs=1e-12)
    flagged = [r for r in scored if r.iso_anomaly]
    assert flagged and len(flagged) <= math.ceil(0.02 * len(scored))
    assert all((r.iso_score_raw < 0) == r.iso_anomaly for r in scored)


def test_the_extreme_row_is_the_most_anomalous(scored):
    lowest = min(scored, key=lambda r: r.iso_score_raw)
    assert lowest.user == "odd" and lowest.iso_anomaly


def test_equal_vectors_get_equal_scores(scored):
    by_vector = {}
    for r in scored:
        by_vector.setdefault(tuple(r[f] for f in FEATURES), set()).add(r.iso_score_raw)
    assert len(by_vector) < len(scored)
    assert all(len(scores) == 1 for scores in by_vector.values())


def test_partitioning_and_order_do_not_matter(days, scored):
    again = forest.fit_forest(days.orderBy(F.rand(5)).repartition(7), SMALL)
    other = again.transform(days.coalesce(1)).collect()
    assert sorted(map(str, other)) == sorted(map(str, scored))


def test_another_seed_gives_another_forest(days, model):
    other = forest.fit_forest(days, Settings(trees=40, subsample=64, seed=7))
    assert not np.array_equal(other.threshold, model.threshold)


def test_null_features_count_as_zero(days, model):
    blank = days.limit(1).selectExpr(
        "user", "day", *[f"cast(null as long) as {f}" for f in FEATURES]
    )
    zero = blank.fillna(0)
    assert (
        model.transform(blank).first().iso_score_raw == model.transform(zero).first().iso_score_raw
    )


def test_empty_and_constant_tables(spark, days):
    empty = forest.isolation_forest_score(days.where("false"), SMALL)
    assert empty.count() == 0 and {"iso_anomaly", "iso_score_raw"} <= set(empty.columns)
    same = spark.range(50).selectExpr("id", *[f"3L as {f}" for f in FEATURES])
    rows = forest.isolation_forest_score(same, SMALL).collect()
    assert len(rows) == 50 and not any(r.iso_anomaly for r in rows)


def test_the_reason_is_added_where_reasons_exist(days, model):
    with_reasons = days.withColumn("reasons", F.array().cast("array<string>"))
    rows = forest.isolation_forest_score(with_reasons, SMALL, model).collect()
    for r in rows:
        expected = ["Flagged as multivariate outlier by anomaly model"] if r.iso_anomaly else []
        assert r.reasons == expected


def test_ranks_are_one_of_each_stratum():
    for total in (1, 2, 63, 64, 65, 1000, 10**12):
        ranks = forest.drawn_ranks(total, SMALL)
        size = min(64, total)
        assert ranks.shape == (40, size)
        for row in ranks.tolist():
            assert len(set(row)) == size
            assert all(k * total // size <= r < (k + 1) * total // size for k, r in enumerate(row))
    assert len({tuple(r) for r in forest.drawn_ranks(10**6, SMALL).tolist()}) == 40


def drawn(spark, counts, settings):
    keyed = forest.with_keys(counts, settings)
    sizes = forest.bucket_sizes(keyed)
    return forest.tree_samples(keyed, sizes, settings), sizes


def test_samples_are_exact_and_fair(spark):
    """A third of nine million rows share one vector; every tree gets its exact number of rows."""
    counts = spark.range(200).selectExpr(
        "if(id = 0, 3000000L, 30150L) as rows",
        *[f"cast(id + {i} as double) as {f}" for i, f in enumerate(FEATURES)],
    )
    settings = Settings(trees=50, subsample=500)
    samples, _ = drawn(spark, counts, settings)
    rows = samples.groupBy("tree", "logon_count").count().collect()
    per_tree = Counter()
    for r in rows:
        per_tree[r.tree] += r["count"]
    assert set(per_tree.values()) == {500} and len(per_tree) == 50
    hot = sum(r["count"] for r in rows if r.logon_count == 0)
    assert hot == pytest.approx(50 * 500 * 3_000_000 / (3_000_000 + 199 * 30_150), rel=0.02)


def test_samples_come_from_all_rows_of_a_large_table(spark):
    """Over 65,536 rows, nearly all vectors different, and samples larger than that."""
    counts = spark.range(100_000).selectExpr(
        "1L + id % 2 as rows", *[f"cast(id + {i} as double) as {f}" for i, f in enumerate(FEATURES)]
    )
    settings = Settings(trees=3, subsample=70_000)
    samples, sizes = drawn(spark, counts, settings)
    assert sum(sizes.values()) == 150_000
    found = samples.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("logon_count").alias("d")).collect()
    assert [r.n for r in found] == [70_000] * 3
    assert all(45_000 < r.d < 70_000 for r in found)
    everything = drawn(spark, counts, Settings(trees=1, subsample=10**6))[0]
    assert everything.count() == 150_000


@pytest.mark.parametrize("rank", [0, 1, 2, 3, 500, 997, 998, 999])
def test_selection_by_rank(spark, rank):
    values = [(i * i * 2654435761) % (1 << 40) for i in range(500)]
    totals = spark.createDataFrame([(v, 2) for v in values], "total long, rows long")
    found, upto = forest.value_at_rank(totals, rank, 40)
    ordered = sorted(values * 2)
    assert found == ordered[rank]
    assert upto == sum(v <= found for v in ordered)
