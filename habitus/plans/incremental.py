"""Scoring only what is new: a run reads the days since the last one and the stored moments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, Settings
from habitus.operators.moments import added, moments
from habitus.sources import generations


def days_between(
    days: DataFrame, after: date | None, until: date, settings: Settings = DEFAULTS
) -> DataFrame:
    """Days later than ``after`` (None: from the first) up to ``until``; the bounds reach the scan."""
    day = F.col(settings.day)
    recent = days.where(day <= F.lit(until))
    return recent if after is None else recent.where(day > F.lit(after))


def last_day(spark: SparkSession, path: str) -> date | None:
    """The day up to which the moments in ``path`` reach."""
    name = generations.latest(spark, path)
    return None if name is None else date.fromisoformat(name)


def next_moments(
    spark: SparkSession, path: str, days: DataFrame, until: date, settings: Settings = DEFAULTS
) -> DataFrame:
    """The moments up to ``until``, from the stored ones and the days since; nothing is written."""
    after = last_day(spark, path)
    fresh = moments(days_between(days, after, until, settings), settings)
    if after is None:
        return fresh
    return added(generations.read(spark, path, after.isoformat()), fresh, settings)


def advance(
    spark: SparkSession, path: str, days: DataFrame, until: date, settings: Settings = DEFAULTS
) -> DataFrame:
    """Store the moments up to ``until`` in ``path`` and return them.

    A generation is named by its last day. A run that is repeated, after success or after a loss,
    adds its days once: they are counted from the last committed generation on. Days that arrive
    later than a generation that covers them are not seen; days without a date belong to no slice.
    """
    after = last_day(spark, path)
    if after is not None and until <= after:
        return generations.read(spark, path, after.isoformat())
    return generations.write(next_moments(spark, path, days, until, settings), path, until.isoformat())
