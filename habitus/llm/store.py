"""Written intermediate tables, size-checked broadcasts and distributed numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.session import scratch_path

#: A table is broadcast only if it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 200_000
#: Tasks whose counts are summed together.
BLOCK = 1024


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the cluster's shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks that run, not the steps before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A stored, narrow table with a broadcast hint if its row count is under the bound.

    Beyond the bound it comes back as it is, and the join shuffles.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def empty_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose key, null included, is not among ``ids`` (one stored column)."""
    gone = small(ids.select(F.col(key).alias("_gone")))
    return df.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")


def earlier_sums(totals: DataFrame, order: tuple[str, ...], amount: str, out: str) -> DataFrame:
    """``totals`` with ``out``: the sum of ``amount`` over all rows before in ``order``; stored.

    The last column of ``order`` numbers tasks. Sums are taken over blocks of ``BLOCK`` tasks and then
    within each, so neither the driver nor one task sees a row of every task of a large table.
    """
    *by, last = order
    block = F.floor(F.col(last) / BLOCK).cast("long").alias("_block")
    totals = store(totals.select("*", block), "totals")
    rows = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = totals.groupBy(*by, "_block").agg(F.sum(amount).alias("_sum"))
    sums = sums.select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("_block").alias("_own"),
        F.coalesce(F.sum("_sum").over(Window.orderBy(*by, "_block").rowsBetween(*rows)), zero).alias("_blocks"),
    )
    same = F.col("_block") == F.col("_own")
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy(*by, "_block").orderBy(last).rowsBetween(*rows)), zero)
    found = totals.join(sums, same).select(*totals.columns, (F.col("_blocks") + within).alias(out))
    return store(found.drop("_block"), "offsets")


def part_offsets(df: DataFrame, amount: Column) -> DataFrame:
    """(_part, _base): sum of ``amount`` over all rows of an earlier ``_part``.

    A row for each part, broadcast if they are few; parts are the tasks that wrote ``df``.
    """
    totals = df.groupBy("_part").agg(F.coalesce(F.sum(amount), F.lit(0)).cast("long").alias("_total"))
    return small(earlier_sums(totals, ("_part",), "_total", "_base").select("_part", "_base"))
