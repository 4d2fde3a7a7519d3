"""Severity names and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from habitus.config import SEVERITIES, SEVERITY_FLOORS


def severity_of(score: Column) -> Column:
    level = F.when(score > 0, F.lit("Low")).otherwise(F.lit("Normal"))
    for name, floor in reversed(SEVERITY_FLOORS):
        level = F.when(score >= floor, F.lit(name)).otherwise(level)
    return level


def rank_of(severity: Column) -> Column:
    """0 for Normal up to 4 for Critical; NULL for any other text."""
    rank = F.lit(None).cast("tinyint")
    for position, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, F.lit(position).cast("tinyint")).otherwise(rank)
    return rank


def levels_from(name: str) -> tuple[str, ...]:
    """The named level and all above it."""
    if name not in SEVERITIES:
        raise ValueError(f"min_severity must be one of {list(SEVERITIES)}")
    return SEVERITIES[SEVERITIES.index(name) :]


def is_flagged(severity: Column) -> Column:
    return severity != "Normal"


def is_drift_only(severity: Column, drift_flag: Column) -> Column:
    return (severity == "Normal") & drift_flag
