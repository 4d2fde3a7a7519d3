"""Each actor's own mean and spread, and how far each day is from it.

For integer features the spread comes from exact sums (n, sum, sum of squares), so
the result is the same bit for bit under any partitioning, retry or order, and a
constant feature has a spread of exactly zero. Squares are summed as decimals:
an actor with a third of a 10^12-row log would overflow a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitus.config import DEFAULTS, Settings


def is_integral(df: DataFrame, feature: str) -> bool:
    return isinstance(df.schema[feature].dataType, T.IntegralType)


def sums(df: DataFrame, settings: Settings) -> dict[str, Column]:
    """The aggregates a baseline is made of, by name."""
    found = {}
    for feature in settings.features:
        if is_integral(df, feature):
            wide = F.col(feature).cast("decimal(19,0)")
            found[f"_n_{feature}"] = F.count(feature)
            found[f"_s_{feature}"] = F.sum(feature)
            found[f"_q_{feature}"] = F.sum(wide * wide)
        else:
            found[f"_avg_{feature}"] = F.avg(feature)
            found[f"_std_{feature}"] = F.stddev_samp(feature)
    return found


def _mean_and_std(feature: str, exact: bool) -> tuple[Column, Column]:
    """Mean and sample spread from the columns of ``sums``.

    The spread is NULL where there is no second value or no variation.
    """
    if not exact:
        return F.col(f"_avg_{feature}"), F.nullif(F.col(f"_std_{feature}"), F.lit(0.0))
    count, total, squares = (F.col(f"_{kind}_{feature}") for kind in "nsq")
    whole = "decimal(20,0)"
    mean = F.when(count > 0, total.cast("double") / count)
    numerator = count.cast(whole) * squares - total.cast(whole) * total.cast(whole)
    variance = numerator.cast("double") / (count * (count - 1)).cast("double")
    return mean, F.when((count > 1) & (numerator > 0), F.sqrt(variance))


def baseline_columns(exact: dict[str, bool], settings: Settings) -> dict[str, Column]:
    """``mean_*`` and ``std_*`` over the columns of ``sums``; ``exact``: which features are integers."""
    columns = {}
    for feature in settings.features:
        columns[f"mean_{feature}"], columns[f"std_{feature}"] = _mean_and_std(feature, exact[feature])
    return columns


def z_of(value: Column, mean: Column, std: Column) -> Column:
    """Distance in spreads; 0 where there is no baseline or no variation."""
    return F.coalesce((value - mean) / std, F.lit(0.0))


def actor_baseline(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``mean_*`` and ``std_*`` per actor, over the whole history."""
    baseline = baseline_columns({f: is_integral(df, f) for f in settings.features}, settings)
    return (
        df.where(F.col(settings.actor).isNotNull())
        .groupBy(settings.actor)
        .agg(*[total.alias(name) for name, total in sums(df, settings).items()])
        .select(settings.actor, *[column.alias(name) for name, column in baseline.items()])
    )


def _add_z(df: DataFrame, settings: Settings) -> DataFrame:
    return df.withColumns(
        {
            f"z_{f}": z_of(F.col(f), F.col(f"mean_{f}"), F.col(f"std_{f}"))
            for f in settings.features
        }
    )


def add_baseline(
    df: DataFrame, baseline: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Add ``mean_*``, ``std_*`` and ``z_*`` from a given baseline."""
    return _add_z(df.join(baseline, settings.actor, "left"), settings)


def zscores(
    df: DataFrame, settings: Settings = DEFAULTS, hashed: bool = False, history: DataFrame | None = None
) -> DataFrame:
    """Add ``mean_*``, ``std_*`` and ``z_*`` for every feature.

    Aggregate, then join back: one combined row per actor is shuffled, and the
    planner broadcasts that small side while it is under its size threshold. A
    heavy actor never sits whole in one task.

    ``hashed``: for rows that are parted by actor already, as behind trailing means. The baseline
    comes out of its aggregation parted alike and is hashed in place, so the rows are neither moved
    nor sorted again. ``history``: what the baseline covers, if that is more than the rows.
    """
    baseline = actor_baseline(df if history is None else history, settings)
    return add_baseline(df, baseline.hint("shuffle_hash") if hashed else baseline, settings)
