"""Baselines that grow: what a mean and a spread are made of, kept per actor and added up.

A slice of days gives one narrow row per actor (count, sum and sum of squares of each feature); rows
of several slices add up to the row of all their days. Sums are exact, so a baseline from slices is
the one of the whole history bit for bit, in whatever order the slices came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, Settings
from habitus.operators.baseline import add_baseline, baseline_columns, is_integral, sums


def moments(days: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per actor with the moments of each (integer) feature; rows without an actor are left out."""
    rough = [f for f in settings.features if not is_integral(days, f)]
    if rough:
        raise ValueError(f"moments add up exactly for integers only, not for {rough}")
    columns = [total.alias(name) for name, total in sums(days, settings).items()]
    return days.where(F.col(settings.actor).isNotNull()).groupBy(settings.actor).agg(*columns)


def added(left: DataFrame, right: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The moments of two disjoint sets of days together; one row per actor is shuffled."""
    names = [c for c in left.columns if c != settings.actor]
    total = [F.sum(c).cast(left.schema[c].dataType).alias(c) for c in names]
    return left.unionByName(right).groupBy(settings.actor).agg(*total)


def baseline_of(found: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``mean_*`` and ``std_*`` per actor, as ``actor_baseline`` has them."""
    columns = baseline_columns(dict.fromkeys(settings.features, True), settings)
    return found.select(settings.actor, *[column.alias(name) for name, column in columns.items()])


def zscores_with(days: DataFrame, found: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Days with ``mean_*``, ``std_*`` and ``z_*`` from stored moments."""
    return add_baseline(days, baseline_of(found, settings), settings)
