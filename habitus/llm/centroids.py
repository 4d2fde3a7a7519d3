"""Exact integer k-means, with nearest centroids found by the threshold algorithm.

For every dimension the centroids stand in a list sorted by their component. From a vector's value
in that dimension the list is walked outward, so that it yields the centroids by rising distance in
this one dimension. All lists are walked at the same pace, and a centroid is compared in full when the
first list yields it. The squared distances at the fronts of all lists add up to what a centroid
that no list has yielded must have at least; the walk stops when this sum strictly exceeds the best
exact distance, so that a tie is never missed, and the smallest number of the nearest is kept.

Vectors are integers, floor(scale * x) for each component, and all sums are exact, so results are
the same under any partitioning, order or retry.

Scale: vectors are converted and stored once. A round is one pass over the stored table; each Arrow
batch returns a row for each centroid, and these are summed by centroid and dimension. The driver
holds the centroids only. There is no shuffle of vectors, so no cluster is ever one task.

Cases: vectors that are null, have another length or a null or non-finite component are left out;
components beyond ``LARGEST`` in size are set to it, so that every distance fits a long; a null id
hashes as the empty text; repeated rows count each; equal distances go to the smaller number;
vectors that repeat among the first centroids leave the later one empty, and empty centroids stay;
with fewer vectors than ``k`` there are fewer centroids; an empty table gives no rows; a total
inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.llm.store import store

DIMENSIONS = 64
SCALE = 1024
K = 8
ROUNDS = 10
SEED = 3
#: Largest component in size: 64 dimensions of twice its square fit a long.
LARGEST = 1 << 27
#: Vectors that are compared at a time.
BATCH = 4096


def integers(
    vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE
) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of integers, stored."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bounded = lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    safe = lambda c: F.greatest(F.least(c, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    kept = vectors.where((F.size(F.col(vector)) == dimensions) & fine)
    return store(
        kept.select(F.col(id_).cast("long").alias("vec_id"), F.transform(x, lambda c: bounded(safe(c))).alias("v")),
        "vectors",
    )


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest sha256 of ``<seed>:<vec_id>``, one row each."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Lists:
    """The centroids' sorted lists, one for each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.k, self.dimensions = centroids.shape
        self.number = np.argsort(centroids, axis=0, kind="stable")
        self.value = np.take_along_axis(centroids, self.number, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid for each row of x."""
        n = len(x)
        best, distance = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        seen = np.zeros((n, self.k), bool)
        # Places in the lists: the next to the left and to the right of each value.
        right = np.empty(x.shape, np.int64)
        for d in range(self.dimensions):
            right[:, d] = np.searchsorted(self.value[:, d], x[:, d])
        left = right - 1
        rows, columns = np.arange(n), np.arange(self.dimensions)[None, :]
        far = np.int64(4 * LARGEST)
        for _ in range(self.k):
            own = x[rows]
            low, high = left[rows], right[rows]
            down = np.where(low >= 0, own - self.value[np.maximum(low, 0), columns], far)
            up = np.where(high < self.k, self.value[np.minimum(high, self.k - 1), columns] - own, far)
            go_down = down <= up
            front = np.where(go_down, down, up)
            yielded = self.number[np.where(go_down, low, high), columns]
            left[rows], right[rows] = low - go_down, high + ~go_down
            new = np.zeros((len(rows), self.k), bool)
            new[np.arange(len(rows))[:, None], yielded] = True
            new &= ~seen[rows]
            seen[rows] |= new
            for c in range(self.k):
                some = np.flatnonzero(new[:, c])
                if len(some):
                    gap = own[some] - self.centroids[c]
                    exact = np.einsum("ij,ij->i", gap, gap)
                    mine = rows[some]
                    better = (exact < distance[mine]) | ((exact == distance[mine]) & (c < best[mine]))
                    best[mine[better]], distance[mine[better]] = c, exact[better]
            bound = np.einsum("ij,ij->i", front, front)
            rows = rows[bound <= distance[rows]]
            if not len(rows):
                break
        return best, distance


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) for every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                cluster, distance = lists.nearest(_matrix(part.column(1), lists.dimensions))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"],
                )

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.slice(at, BATCH).column(0), dimensions)
                cluster, _ = lists.nearest(x)
                for c in np.unique(cluster):
                    sums[c] += x[cluster == c].sum(axis=0)
                counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(some, dimensions).astype(np.int32)),
                pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(some))),
                pa.array(sums[some].ravel()), pa.array(np.repeat(counts[some], dimensions)),
            ],
            names=["cluster", "dimension", "total", "n"],
        )

    parts = vectors.select("v").mapInArrow(run, "cluster int, dimension int, total long, n long")
    wide = parts.groupBy("cluster", "dimension").agg(
        F.sum(F.col("total").cast("decimal(28,0)")).alias("total"), F.sum("n").alias("n")
    )
    out = centroids.copy()
    for row in wide.collect():  # k rows for each dimension
        out[row["cluster"], row["dimension"]] = int(row["total"]) // row["n"]
    return out


def cluster(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS,
    scale: int = SCALE, id_: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """The stored assignment (vec_id, cluster, distance) after ``rounds`` rounds, and the centroids."""
    kept = integers(vectors, id_, vector, dimensions, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), centroids
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    return store(assigned(kept, centroids), "clusters"), centroids


def summed(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with cluster_inertia, inertia and centroid_sha256."""
    distance = F.sum(F.col("distance").cast("decimal(28,0)"))
    totals = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(distance.alias("total")).collect()}
    whole, most = sum(totals.values()), np.iinfo(np.int64).max
    rows = [
        (c, total if total <= most else None, whole if whole <= most else None,
         hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, total in totals.items()
    ]  # one for each centroid
    sums = found.sparkSession.createDataFrame(
        rows, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(sums), F.col("cluster") == F.col("_cluster")).drop("_cluster")
