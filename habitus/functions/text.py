"""Sentences that say why a day was flagged.

Numbers are rounded half-even on the exact binary value. ``format_number`` with a
pattern does that; ``format_string('%.1f')`` and ``round`` go half-up instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, MODEL_REASON, NO_RULE_TEXT, Settings


def one_decimal(value: Column) -> Column:
    return F.call_function("format_number", value.cast("double"), F.lit("0.0"))


def whole_number(value: Column) -> Column:
    return F.call_function("format_number", value.cast("double"), F.lit("0"))


def label_of(feature: str) -> str:
    return feature.replace("_", " ")


def ceiling(mean: Column, std: Column, settings: Settings = DEFAULTS) -> Column:
    """The value up to which a day would not have been flagged."""
    return mean + F.lit(settings.z_threshold) * std


def rule_sentence(
    feature: str,
    z: Column,
    mean: Column | None = None,
    std: Column | None = None,
    settings: Settings = DEFAULTS,
) -> Column:
    """Sentence for one rule, with the counterfactual where a baseline is known."""
    start = F.concat(
        F.lit(f"{label_of(feature)} unusually high for this user (z="),
        one_decimal(z),
        F.lit(")"),
    )
    if mean is None or std is None:
        return start
    counterfactual = F.concat(
        F.lit(" — would not flag below "),
        one_decimal(ceiling(mean, std, settings)),
        F.lit(" (actual: "),
        whole_number(mean + z * std),
        F.lit(")"),
    )
    known = mean.isNotNull() & std.isNotNull() & (std > 0)
    return F.concat(start, F.when(known, counterfactual).otherwise(F.lit("")))


def drift_sentence(
    feature: str, recent: Column, mean: Column, z: Column, settings: Settings = DEFAULTS
) -> Column:
    return F.concat(
        F.lit(
            f"sustained rise in {label_of(feature)} over the trailing "
            f"{settings.drift_window} days (recent avg "
        ),
        one_decimal(recent),
        F.lit(" vs personal baseline "),
        one_decimal(mean),
        F.lit(", trend z="),
        one_decimal(z),
        F.lit(")"),
    )


def join_sentences(reasons: Column, default: str = "") -> Column:
    """An array of sentences as one text; ``default`` where there is none."""
    joined = F.concat_ws("; ", reasons)
    return F.when(F.size(reasons) > 0, joined).otherwise(F.lit(default))


def with_model_sentence(reasons: Column, anomaly: Column) -> Column:
    added = F.array_append(reasons, F.lit(MODEL_REASON))
    return F.when(anomaly, added).otherwise(reasons)


def table_reason(reasons: Column, drift_flag: Column, drift_reasons: Column) -> Column:
    """Text of the ranked table: drift replaces the default text, else follows."""
    both = F.concat(reasons, F.lit("; "), drift_reasons)
    with_drift = F.when(reasons == NO_RULE_TEXT, drift_reasons).otherwise(both)
    return F.when(drift_flag, with_drift).otherwise(reasons)


def history_reason(
    severity: Column, reasons: Column, drift_flag: Column, drift_reasons: Column
) -> Column:
    """Text of one actor's history: decided by severity, not by the text."""
    flagged = severity != "Normal"
    return (
        F.when(flagged & drift_flag, F.concat(reasons, F.lit("; "), drift_reasons))
        .when(flagged, reasons)
        .otherwise(drift_reasons)
    )
