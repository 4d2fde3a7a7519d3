"""Points to levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, NO_RULE_TEXT, Settings
from habitus.functions.levels import severity_of
from habitus.functions.text import join_sentences


def final_severity(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``severity_score`` (rules plus the model's bonus) and ``severity``."""
    bonus = F.col("iso_anomaly").cast("int") * F.lit(settings.outlier_weight)
    return df.withColumn("severity_score", F.col("rule_score") + bonus).withColumn(
        "severity", severity_of(F.col("severity_score"))
    )


def flatten_reasons(df: DataFrame) -> DataFrame:
    """The reasons as one text, with a default where no rule fired."""
    return df.withColumn("reasons", join_sentences(F.col("reasons"), NO_RULE_TEXT))
