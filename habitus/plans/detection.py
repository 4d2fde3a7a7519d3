"""From a feature table to scored, explained days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, Settings
from habitus.functions.text import with_model_sentence
from habitus.operators.baseline import actor_baseline, add_baseline
from habitus.operators.drift import drift_signal, recent_means
from habitus.operators.forest import IsolationForestModel, fit_forest
from habitus.operators.rules import rule_scores
from habitus.operators.severity import final_severity, flatten_reasons
from habitus.session import cut_lineage


def score_days(
    features: DataFrame,
    model: IsolationForestModel | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Baseline, rules, model, drift, severity and reasons in one plan.

    The rows are exchanged and sorted once, by (actor, day) for the trailing means, while
    they are still narrow. The baseline comes out of its own aggregation partitioned by
    actor, so hashing it in place joins it without moving the rows again and without a
    broadcast that grows with the number of actors. The rest are column expressions
    and, with a model, one map. Without a model no day is an outlier.
    """
    if model is None:
        days = features.withColumns(
            {"iso_score_raw": F.lit(None).cast("double"), "iso_anomaly": F.lit(False)}
        )
    else:
        days = model.transform(features)
    baseline = actor_baseline(features, settings).hint("shuffle_hash")
    scored = rule_scores(add_baseline(recent_means(days, settings), baseline, settings), settings)
    explained = scored.withColumn(
        "reasons", with_model_sentence(F.col("reasons"), F.col("iso_anomaly"))
    )
    return flatten_reasons(final_severity(drift_signal(explained, settings), settings))


def detect(features: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The full detection with a model fitted on the same table.

    The table is written to the shared folder first, as the fit, the baseline and the scores
    each read it.
    """
    stored = cut_lineage(features, "actor-days")
    return score_days(stored, fit_forest(stored, settings), settings)
