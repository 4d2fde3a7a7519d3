"""Global order without a task that sees all rows: range partitions, their totals, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.llm.store import small, store


def in_ranges(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` dealt out by ranges of ``order`` and stored, with the number of the range as ``_part``.

    Rows that are equal in all of ``order`` share a range. Give narrow and stored rows: Spark reads
    them twice, once for a sample of bounds.
    """
    return store(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


def before_ranges(parts: DataFrame, amount: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., _part, _before, _total): sum of ``amount`` in a range and in all earlier ones.

    One row for each range and each value of ``by`` in it. Ranges are as many as the session's
    shuffle partitions at most, so the running sum over them is short whatever the table's size.
    """
    totals = store(parts.groupBy(*by, "_part").agg(F.sum(amount).alias("_total")), "range-totals")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0).cast("long")))


def numbered(df: DataFrame, order: list, number: str, name: str = "numbered") -> DataFrame:
    """``df`` with ``number``: the place of each row in ``order``, gapless from 0.

    Give narrow and stored rows; rows that are equal in all of ``order`` are numbered in any way.
    """
    parts = in_ranges(df, order, name)
    base = before_ranges(parts, F.lit(1).cast("long")).select("_part", "_before")
    within = Window.partitionBy("_part").orderBy(*order)
    place = F.row_number().over(within).cast("long") - 1 + F.col("_before")
    return parts.join(small(store(base, name)), "_part").withColumn(number, place).drop("_part", "_before")
