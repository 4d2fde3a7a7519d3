"""Settings shared by all operators.

Every operator takes a :class:`Settings` so that another log with an actor, a
timestamp and countable activity can use the same pipeline under other names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The defaults below define what a flagged day is.
FEATURES = (
    "logon_count",
    "off_hours_logon_count",
    "distinct_pcs",
    "usb_connect_count",
    "off_hours_usb_count",
)

# Points per rule; the order is the order of the reasons.
RULE_WEIGHTS = (
    ("off_hours_logon_count", 3),
    ("off_hours_usb_count", 3),
    ("usb_connect_count", 2),
    ("distinct_pcs", 2),
    ("logon_count", 1),
)

# Severity names from lowest to highest.
SEVERITIES = ("Normal", "Low", "Medium", "High", "Critical")

# Lowest score of each level; Low is any score above zero.
SEVERITY_FLOORS = (("Critical", 8), ("High", 5), ("Medium", 2))

# The columns a reader of scored days gets, in order.
SERVED_COLUMNS = (
    "user",
    "day",
    "role",
    "department",
    "team",
    "severity",
    "severity_score",
    "reasons",
    "logon_count",
    "off_hours_logon_count",
    "distinct_pcs",
    "usb_connect_count",
    "off_hours_usb_count",
    "iso_anomaly",
    "drift_flag",
    "drift_reasons",
)

# The columns of the ranked preview file.
PREVIEW_COLUMNS = (
    "user",
    "day",
    "severity",
    "severity_score",
    "role",
    "department",
    "reasons",
)

# Fixed texts.
NO_RULE_TEXT = "No specific rule triggered"
MODEL_REASON = "Flagged as multivariate outlier by anomaly model"
UNKNOWN = "Unknown"


@dataclass(frozen=True)
class Settings:
    """Names, thresholds and model sizes of one detection run."""

    actor: str = "user"
    day: str = "day"
    features: tuple[str, ...] = FEATURES

    off_hours_start: int = 20
    off_hours_end: int = 6

    z_threshold: float = 2.5
    rule_weights: tuple[tuple[str, int], ...] = RULE_WEIGHTS
    outlier_weight: int = 2

    drift_window: int = 14
    drift_threshold: float = 3.0

    trees: int = 200
    subsample: int = 256
    contamination: float = 0.02
    seed: int = 42

    row_group_rows: int = 20_000
    served_columns: tuple[str, ...] = field(default=SERVED_COLUMNS)


DEFAULTS = Settings()
