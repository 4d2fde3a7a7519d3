"""Slow, sustained rises: a trailing average against the actor's own baseline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, Settings
from habitus.functions.text import drift_sentence, join_sentences


def _recent_mean(feature: str, settings: Settings) -> Column:
    """Mean of the last rows of the actor (not calendar days); NULL until full."""
    trailing = (
        Window.partitionBy(settings.actor)
        .orderBy(settings.day)
        .rowsBetween(1 - settings.drift_window, Window.currentRow)
    )
    full = F.count(feature).over(trailing) >= settings.drift_window
    total = F.sum(feature).over(trailing).cast("double")
    return F.when(full, total / F.lit(float(settings.drift_window)))


def has_baseline(df: DataFrame, settings: Settings = DEFAULTS) -> bool:
    needed = [settings.actor, settings.day]
    for feature in settings.features:
        needed += [f"mean_{feature}", f"std_{feature}"]
    return set(needed) <= set(df.columns)


def recent_means(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``recent_*``, the trailing mean of each feature.

    The window runs per actor; an actor has at most one row per calendar day there, so
    that even the heaviest one is a short partition.
    """
    known = F.col(settings.actor).isNotNull()
    return df.withColumns(
        {f"recent_{f}": F.when(known, _recent_mean(f, settings)) for f in settings.features}
    )


def drift_zscores(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``drift_z_*``, and ``recent_*`` unless it is there.

    The trailing mean is measured in standard errors of a mean of that many days.
    """
    if not {f"recent_{f}" for f in settings.features} <= set(df.columns):
        df = recent_means(df, settings)
    root = math.sqrt(settings.drift_window)
    z = {
        f"drift_z_{f}": F.coalesce(
            (F.col(f"recent_{f}") - F.col(f"mean_{f}"))
            / (F.nullif(F.col(f"std_{f}"), F.lit(0.0)) / F.lit(root)),
            F.lit(0.0),
        )
        for f in settings.features
    }
    return df.withColumns(z)


def drift_signal(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``drift_flag`` and ``drift_reasons``; no baseline means no drift."""
    if not has_baseline(df, settings):
        return df.withColumns({"drift_flag": F.lit(False), "drift_reasons": F.lit("")})
    scored = drift_zscores(df, settings)
    fires = {f: F.col(f"drift_z_{f}") > settings.drift_threshold for f in settings.features}
    sentences = [
        F.when(
            fires[f],
            drift_sentence(
                f, F.col(f"recent_{f}"), F.col(f"mean_{f}"), F.col(f"drift_z_{f}"), settings
            ),
        )
        for f in settings.features
    ]
    any_fires = fires[settings.features[0]]
    for feature in settings.features[1:]:
        any_fires = any_fires | fires[feature]
    helpers = [f"{kind}_{f}" for f in settings.features for kind in ("recent", "drift_z")]
    return scored.withColumns(
        {
            "drift_flag": any_fires,
            "drift_reasons": join_sentences(F.array_compact(F.array(*sentences))),
        }
    ).drop(*helpers)
