from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from habitus.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k=8, rounds=10, size=64):
    """The same by loops over all centroids."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            centers[n] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    total = {}
    for _, c, d in found:
        total[c] = total.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    key = lambda r: tuple(map(str, r))
    return sorted([(i, c, d, total[c], sum(total.values()), sha[c]) for i, c, d in found], key=key)


def result(df):
    got = [tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
           for r in df.collect()]
    return sorted(got, key=lambda r: tuple(map(str, r)))


def vectors(n, seed=1, groups=5, size=64):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(groups)]
    return [(k, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)]) for k in range(n)]


def test_clusters_equal_loops(spark):
    rows = vectors(150)
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (1000, rows[0][1])]  # repeated, null
    odd = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [math.nan] * 64), (2004, [math.inf] + [0.0] * 63),
           (2005, [None] + [0.0] * 63)]
    got = result(centroids.summed(*centroids.cluster(table(spark, rows + odd))))
    assert got == plain(rows + odd)


def test_repeated_first_centroids_stay_empty(spark):
    rows = [(k, [float(k // 6)] * 64) for k in range(12)]
    got = result(centroids.summed(*centroids.cluster(table(spark, rows))))
    assert got == plain(rows)
    assert len({r[1] for r in got}) == 2


@pytest.mark.parametrize("k", [1, 2, 8, 40])
def test_walk_finds_the_nearest_and_the_smallest_of_ties(k):
    rng = np.random.default_rng(k)
    for spread in (2, 50, 10**8):
        middles = rng.integers(-spread, spread + 1, (k, 6))
        x = rng.integers(-spread - 1, spread + 2, (500, 6))
        gaps = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2)
        number, distance = centroids.Lists(middles).nearest(x)
        assert (number == gaps.argmin(axis=1)).all() and (distance == gaps.min(axis=1)).all()


def test_the_walk_stops_early():
    """Few dimensions, many centroids: most are never compared in full."""
    rng = np.random.default_rng(0)
    middles = rng.integers(-10**6, 10**6, (400, 2))
    lists, compared = centroids.Lists(middles), []
    lists.centroids = type("Counted", (), {"__getitem__": lambda _, c: (compared.append(c), middles[c])[1]})()
    x = rng.integers(-10**6, 10**6, (1, 2))
    assert lists.nearest(x)[0] == ((x - middles) ** 2).sum(axis=1).argmin()
    assert len(compared) < 100


def test_general_sizes(spark):
    rows = [(k, [float(k % 3), float(k % 5)]) for k in range(40)]
    found, middles = centroids.cluster(table(spark, rows), k=3, rounds=4, dimensions=2)
    assert middles.shape == (3, 2) and found.count() == 40


def test_few_or_no_vectors(spark):
    few = vectors(3)
    assert result(centroids.summed(*centroids.cluster(table(spark, few)))) == plain(few)
    assert result(centroids.summed(*centroids.cluster(table(spark, few).where("false")))) == []
    huge = result(centroids.summed(*centroids.cluster(table(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)]))))
    assert [r[2] for r in huge] == [0, 0]
