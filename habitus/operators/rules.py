"""Weighted rules over the z-scores, with the reasons in words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, Settings
from habitus.functions.text import ceiling, rule_sentence


def rule_scores(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``rule_score`` and the array ``reasons``; a rule fires strictly above.

    Only the ``z_*`` columns are needed. Where a feature has ``mean_*`` and
    ``std_*`` too, its sentence also says below which value it would not fire.
    """
    points, sentences = [], []
    for feature, weight in settings.rule_weights:
        z = F.col(f"z_{feature}")
        mean, std = f"mean_{feature}", f"std_{feature}"
        known = mean in df.columns and std in df.columns
        fires = z > settings.z_threshold
        sentence = rule_sentence(
            feature,
            z,
            F.col(mean) if known else None,
            F.col(std) if known else None,
            settings,
        )
        points.append(F.when(fires, F.lit(float(weight))).otherwise(F.lit(0.0)))
        sentences.append(F.when(fires, sentence))
    return df.withColumns(
        {
            "rule_score": reduce(lambda a, b: a + b, points),
            "reasons": F.array_compact(F.array(*sentences)),
        }
    )


def ceilings(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``ceiling_*``: the value up to which each feature would not be flagged."""
    return df.withColumns(
        {
            f"ceiling_{f}": ceiling(F.col(f"mean_{f}"), F.col(f"std_{f}"), settings)
            for f in settings.features
        }
    )
