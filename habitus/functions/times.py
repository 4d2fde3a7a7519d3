"""Timestamps, days and hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, Settings

# Fixed value: how log files write a timestamp; one-digit parts are accepted.
LOG_FORMAT = "M/d/yyyy H:m:s"


def strict_timestamp(text: Column, fmt: str = LOG_FORMAT) -> Column:
    """Zone-less timestamp of a log line; any other text fails the job.

    With ANSI mode the parse itself fails; the explicit error keeps that true in
    a session that has ANSI mode off, where the parse would give NULL.
    """
    problem = F.raise_error(F.concat(F.lit(f"not a timestamp like {fmt}: "), text))
    return F.coalesce(
        F.to_timestamp_ntz(text, F.lit(fmt)),
        F.when(text.isNotNull(), problem.cast("timestamp_ntz")),
    )


def lenient_timestamp(text: Column) -> Column:
    """Zone-less timestamp of an ISO or month/day/year text; NULL if it is neither."""
    return F.coalesce(
        text.try_cast("timestamp_ntz"),
        F.try_to_date(text, "M/d/yyyy").cast("timestamp_ntz"),
    )


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def day_text(day: Column) -> Column:
    """A day as ``yyyy-MM-dd``."""
    return F.date_format(day, "yyyy-MM-dd")


def is_off_hours(hour: Column, settings: Settings = DEFAULTS) -> Column:
    """True from the evening bound on and before the morning bound."""
    return (hour >= settings.off_hours_start) | (hour < settings.off_hours_end)
