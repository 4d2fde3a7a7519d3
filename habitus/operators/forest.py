"""Isolation forest over the feature vectors (Liu, Ting & Zhou, ICDM 2008).

Shape of the work:

* ``fit`` reads the table once, to count equal vectors. Counts of activity take few
  distinct values, so this map-side combined count is far smaller than the table;
  everything else in ``fit`` runs on it.
* Each tree draws exactly ``subsample`` rows (or all, if there are fewer) without
  replacement: one rank from each of as many equal strata of the rows, ordered by a hash of
  their vector. Ranks come from md5, and lead to vectors by sums of multiplicities per
  hash bucket and, within a bucket, per vector. So neither the size of the table nor a hot
  vector matters, no row is left out of the draw, and the sample is the same under any
  partitioning or retry, and in any engine that has md5.
* Trees are built in parallel, one group of at most ``subsample`` rows per tree; feature and
  value of a split come from md5 as well.
* The model is ``trees`` fixed-size arrays (about 1 MB by default), small by
  construction, and is broadcast.
* ``transform`` is a map: no shuffle and no join, so a vector shared by a third of all
  rows is harmless. A batch scores each distinct vector once.

Path lengths are summed as fixed-point integers, so equal vectors get equal scores
whatever batch they come in, and the contamination quantile is an exact selection over
integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitus.config import DEFAULTS, Settings
from habitus.functions.text import with_model_sentence
from habitus.session import cut_lineage

_FIXED = 1 << 24  # fixed-point steps per unit of path length
_BUCKET_BITS = 18  # a selection pass brings at most 2**18 counts to the driver
_KEY_DIGITS = 3  # hexadecimal digits of a vector's hash that choose its bucket
_EULER = 0.5772156649015329


def average_path(size: float) -> float:
    """Mean path length of an unsuccessful search among ``size`` points."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1.0) + _EULER) - 2.0 * (size - 1.0) / size


def tree_height(subsample: int) -> int:
    return max(1, math.ceil(math.log2(max(subsample, 2))))


def _digest(*parts: int) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def split_draws(seed: int, tree: int) -> Callable[[int], tuple[int, float]]:
    """For each slot of a tree: a number that picks the feature, and a share of its range."""

    def draw(slot: int) -> tuple[int, float]:
        digits = _digest(seed, tree, slot)
        return int(digits[:8], 16), int(digits[8:21], 16) / 2.0**52

    return draw


def drawn_ranks(total: int, settings: Settings = DEFAULTS) -> np.ndarray:
    """The ranks of each tree's sample, one from each stratum (trees x sample)."""
    size = min(settings.subsample, total)
    bounds = [k * total // size for k in range(size + 1)]
    return np.array(
        [
            [
                low + int(_digest(settings.seed, tree, k)[:15], 16) % (high - low)
                for k, (low, high) in enumerate(zip(bounds, bounds[1:]))
            ]
            for tree in range(settings.trees)
        ],
        dtype=np.int64,
    )


def grow_tree(
    points: np.ndarray, height: int, draw: Callable[[int], tuple[int, float]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree as a complete binary tree of the given height.

    Returns feature and threshold per inner slot and the fixed-point path length per
    leaf slot. A leaf reached early fills all leaf slots below it.
    """
    inner, leaves = (1 << height) - 1, 1 << height
    feature = np.zeros(inner, dtype=np.int32)
    threshold = np.full(inner, np.inf)
    value = np.zeros(leaves, dtype=np.int64)
    pending = [(0, 0, points)]
    while pending:
        slot, depth, here = pending.pop()
        low, high = here.min(axis=0), here.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth == height or not len(varying):
            span = 1 << (height - depth)
            first = (slot + 1) * span - leaves
            value[first : first + span] = round((depth + average_path(len(here))) * _FIXED)
            continue
        pick, share = draw(slot)
        chosen = int(varying[pick % len(varying)])
        cut = low[chosen] + share * (high[chosen] - low[chosen])
        if cut >= high[chosen]:
            cut = low[chosen]
        feature[slot], threshold[slot] = chosen, cut
        right = here[:, chosen] > cut
        pending.append((2 * slot + 2, depth + 1, here[right]))
        pending.append((2 * slot + 1, depth + 1, here[~right]))
    return feature, threshold, value


def path_totals(
    points: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray
) -> np.ndarray:
    """Fixed-point path length of each point, summed over all trees."""
    trees, inner = feature.shape
    height = (inner + 1).bit_length() - 1
    tree = np.arange(trees)[:, None]
    row = np.arange(len(points))[None, :]
    slot = np.zeros((trees, len(points)), dtype=np.int64)
    for _ in range(height):
        goes_right = points[row, feature[tree, slot]] > threshold[tree, slot]
        slot = 2 * slot + 1 + goes_right
    return value[tree, slot - inner].sum(axis=0)


def _scorer(model: Broadcast):
    """Vectorised path length; scores each distinct vector of a batch once."""

    @F.pandas_udf(T.LongType())
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, threshold, value = model.value
        chunk = max(1, (1 << 22) // max(1, len(feature)))
        for batch in batches:
            points = np.column_stack([s.to_numpy(dtype=np.float64) for s in batch])
            distinct, back = np.unique(points, axis=0, return_inverse=True)
            totals = [
                path_totals(distinct[i : i + chunk], feature, threshold, value)
                for i in range(0, len(distinct), chunk)
            ]
            found = np.concatenate(totals) if totals else np.zeros(0, dtype=np.int64)
            yield pd.Series(found[back.reshape(-1)], dtype="int64")

    return score


def _vector(settings: Settings) -> list[Column]:
    """The features as doubles with NULL read as 0."""
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in settings.features]


def vector_counts(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Each distinct feature vector with the number of rows that have it."""
    return (
        df.select(*_vector(settings))
        .groupBy(*settings.features)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def with_keys(counts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``key``, the md5 of the vector as text, and ``bucket``, its first digits."""
    key = F.md5(F.concat_ws(",", *[F.col(f).cast("string") for f in settings.features]))
    return counts.withColumn("key", key).withColumn(
        "bucket", F.conv(F.substring("key", 1, _KEY_DIGITS), 16, 10).cast("int")
    )


def tree_samples(
    keyed: DataFrame, sizes: dict[int, int], settings: Settings = DEFAULTS
) -> DataFrame:
    """``tree`` and vector of each drawn row.

    ``sizes``: rows per bucket. The driver turns trees x subsample ranks, whose number does
    not depend on the table, into a bucket and a place in it; the bucket's vectors are
    numbered by running sums.
    """
    spark = keyed.sparkSession
    buckets = np.array(sorted(sizes))
    ends = np.cumsum([sizes[b] for b in buckets])
    ranks = drawn_ranks(int(ends[-1]), settings)
    at = np.searchsorted(ends, ranks.ravel(), "right")
    draws = pa.table(
        {
            "tree": np.repeat(np.arange(len(ranks), dtype=np.int32), ranks.shape[1]),
            "bucket": buckets[at].astype(np.int32),
            "place": ranks.ravel() - (ends[at] - np.array([sizes[b] for b in buckets])[at]),
        }
    )
    line = Window.partitionBy("bucket").orderBy("key", *settings.features)
    numbered = keyed.withColumn("end", F.sum("rows").over(line))
    inside = (F.col("place") >= F.col("end") - F.col("rows")) & (F.col("place") < F.col("end"))
    return (
        numbered.join(F.broadcast(spark.createDataFrame(draws)), "bucket")
        .where(inside)
        .select("tree", *settings.features)
    )


def _tree_builder(settings: Settings, height: int):
    names = list(settings.features)

    def build(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        points = sample[names].to_numpy(dtype=np.float64)
        feature, threshold, value = grow_tree(points, height, split_draws(settings.seed, tree))
        return pd.DataFrame(
            {"tree": [tree], "feature": [feature], "threshold": [threshold], "value": [value]}
        )

    return build


def value_at_rank(totals: DataFrame, rank: int, bits: int) -> tuple[int, int]:
    """Value at a 0-based rank of the weighted column ``total``, and the rows up to it.

    ``totals`` has non-negative integers below ``2**bits`` with their ``rows``. Radix
    selection: each pass counts rows per bucket of the range still open and descends
    into the bucket that holds the rank. A pass returns at most 2**18 counts to the
    driver, and the number of passes depends only on ``bits``.
    """
    low, before, upto = 0, 0, 0
    while bits > 0:
        shift = max(0, bits - _BUCKET_BITS)
        open_range = (F.col("total") >= low) & (F.col("total") < F.lit(low + (1 << bits)))
        bucket = F.shiftright(F.col("total") - F.lit(low), shift)
        counted = (
            totals.where(open_range).groupBy(bucket.alias("bucket")).agg(F.sum("rows").alias("rows"))
        )
        for number, rows in sorted(tuple(row) for row in counted.collect()):
            upto = before + rows
            if upto > rank:
                low += number << shift
                break
            before = upto
        bits = shift
    return low, upto


@dataclass(frozen=True)
class IsolationForestModel:
    """Fitted trees, and the two path totals the contamination quantile lies between."""

    settings: Settings
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    sample_size: int
    quantile_low: int = 0
    quantile_high: int = 0
    quantile_fraction: float = 0.0

    @property
    def trees(self) -> int:
        return len(self.feature)

    def path_total(self, df: DataFrame) -> Column:
        arrays = (self.feature, self.threshold, self.value)
        shared = df.sparkSession.sparkContext.broadcast(arrays)
        return _scorer(shared)(*_vector(self.settings))

    def score_of(self, total: Column) -> Column:
        """Minus the anomaly score of the paper: between -1 (odd) and 0."""
        scale = max(average_path(self.sample_size), 1e-12) * _FIXED * max(1, self.trees)
        return -F.pow(F.lit(2.0), -(total.cast("double") / F.lit(scale)))

    def offset(self) -> Column:
        """Contamination quantile of the scores, interpolated between two rows."""
        low = self.score_of(F.lit(self.quantile_low))
        high = self.score_of(F.lit(self.quantile_high))
        return low + (high - low) * F.lit(self.quantile_fraction)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``iso_score_raw`` (negative is anomalous) and ``iso_anomaly``."""
        if self.trees == 0:
            return df.withColumns({"iso_score_raw": F.lit(0.0), "iso_anomaly": F.lit(False)})
        return (
            df.withColumn("_path_total", self.path_total(df))
            .withColumn("iso_score_raw", self.score_of(F.col("_path_total")) - self.offset())
            .withColumn("iso_anomaly", F.col("iso_score_raw") < 0)
            .drop("_path_total")
        )


def _no_trees(settings: Settings) -> IsolationForestModel:
    none = np.zeros((0, 1))
    return IsolationForestModel(settings, none, none, none, 0)


def fit_trees(
    keyed: DataFrame, sizes: dict[int, int], settings: Settings = DEFAULTS
) -> IsolationForestModel:
    """Grow the trees in parallel on samples of the counted vectors."""
    sample_size = min(settings.subsample, sum(sizes.values()))
    grown = (
        tree_samples(keyed, sizes, settings)
        .groupBy("tree")
        .applyInPandas(
            _tree_builder(settings, tree_height(sample_size)),
            "tree int, feature array<int>, threshold array<double>, value array<long>",
        )
        .collect()  # one bounded row per tree
    )
    grown = sorted(grown, key=lambda row: row.tree)
    return IsolationForestModel(
        settings,
        np.array([row.feature for row in grown], dtype=np.int32),
        np.array([row.threshold for row in grown], dtype=np.float64),
        np.array([row.value for row in grown], dtype=np.int64),
        sample_size,
    )


def bucket_sizes(keyed: DataFrame) -> dict[int, int]:
    """Rows per bucket: at most 16**3 numbers, whose sum is the size of the table."""
    return dict(map(tuple, keyed.groupBy("bucket").agg(F.sum("rows")).collect()))


def fit_forest(df: DataFrame, settings: Settings = DEFAULTS) -> IsolationForestModel:
    """Fit the forest and its contamination quantile on all rows of ``df``."""
    counts = cut_lineage(with_keys(vector_counts(df, settings), settings))
    sizes = bucket_sizes(counts)
    total = sum(sizes.values())
    if total == 0:
        return _no_trees(settings)
    model = fit_trees(counts, sizes, settings)
    totals = cut_lineage(
        counts.select(model.path_total(counts).alias("total"), "rows")
        .groupBy("total")
        .agg(F.sum("rows").alias("rows"))
    )
    position = settings.contamination * (total - 1)
    below = math.floor(position)
    bits = int(model.value.max(axis=1).sum()).bit_length()
    low, upto = value_at_rank(totals, below, bits)
    high = low
    if below + 1 < total and upto <= below + 1:
        high = totals.where(F.col("total") > low).agg(F.min("total")).first()[0]
    return replace(
        model, quantile_low=low, quantile_high=high, quantile_fraction=position - below
    )


def isolation_forest_score(
    df: DataFrame,
    settings: Settings = DEFAULTS,
    model: IsolationForestModel | None = None,
) -> DataFrame:
    """Add ``iso_anomaly`` and ``iso_score_raw``; an anomaly adds a reason.

    Without a given model one is fitted on ``df`` itself.
    """
    model = model or fit_forest(df, settings)
    scored = model.transform(df)
    if "reasons" not in df.columns:
        return scored
    return scored.withColumn(
        "reasons", with_model_sentence(F.col("reasons"), F.col("iso_anomaly"))
    )
