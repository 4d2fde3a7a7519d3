"""Size, range and distribution of the stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, Settings

# The numeric columns of a feature table.
PROFILED = (
    "logon_count",
    "off_hours_logon_count",
    "distinct_pcs",
    "first_logon_hour",
    "last_logon_hour",
    "usb_connect_count",
    "off_hours_usb_count",
)


def load_summary(log: DataFrame, date: str = "date") -> DataFrame:
    """Rows and date range of a loaded log."""
    return log.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def feature_summary(features: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows and distinct actors of a feature table."""
    return features.agg(
        F.count(F.lit(1)).alias("user_days"),
        F.count_distinct(settings.actor).alias("users"),
    )


def sample_rows(
    features: DataFrame, count: int = 10, settings: Settings = DEFAULTS
) -> DataFrame:
    """The first rows by actor and day, to look at."""
    return features.orderBy(settings.actor, settings.day).limit(count)


def describe(features: DataFrame, columns: tuple[str, ...] = PROFILED) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each column of whole numbers.

    Equal rows of the columns are counted first, with a map-side combine: counts and hours
    take few distinct values, so that only few rows are then told apart by column. Moments
    are exact sums of whole numbers; quartiles come from running counts over the sorted
    distinct values, which stream and spill.
    """
    rows_of = features.groupBy(*[F.col(c).cast("long").alias(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    values = (
        rows_of.selectExpr(f"stack({len(columns)}, {pairs}) as (feature, value)", "_rows")
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.sum("_rows").alias("rows"))
    )
    exact, rows = F.col("value").cast("decimal(18,0)"), F.col("rows").cast("decimal(18,0)")
    moments = values.groupBy("feature").agg(
        F.sum("rows").alias("count"),
        F.sum(exact * rows).alias("total"),
        F.sum((exact * exact).cast("decimal(38,0)") * rows).alias("squares"),
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
    )
    count, total = F.col("count"), F.col("total")
    places = {f"p{round(100 * q)}": F.lit(q) * (count - 1) for q in (0.25, 0.5, 0.75)}
    upto = F.sum("rows").over(Window.partitionBy("feature").orderBy("value"))
    ranked = values.withColumn("upto", upto).join(F.broadcast(moments), "feature")

    def first_over(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("value"))).cast("double")

    sides = [
        side
        for name, place in places.items()
        for side in (
            first_over(F.floor(place)).alias(f"{name}_low"),
            first_over(F.floor(place) + 1).alias(f"{name}_high"),
        )
    ]
    keys = ("feature", "count", "total", "squares", "min", "max")
    found = ranked.groupBy(*keys).agg(*sides)

    def quartile(name: str) -> Column:
        low, place = F.col(f"{name}_low"), places[name]
        high = F.coalesce(F.col(f"{name}_high"), low)
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    n = count.cast("decimal(18,0)")
    variance = (n * F.col("squares") - total * total).cast("double") / F.nullif(
        (count * (count - 1)).cast("double"), F.lit(0.0)
    )
    return found.select(
        "feature",
        "count",
        (total.cast("double") / count).alias("mean"),
        F.sqrt(variance).alias("std"),
        "min",
        *[quartile(name) for name in places],
        "max",
    )
