from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from habitus.config import NO_RULE_TEXT, SEVERITIES, SEVERITY_FLOORS
from habitus.functions.levels import levels_from, rank_of, severity_of
from habitus.functions.text import with_model_sentence
from habitus.operators.severity import final_severity, flatten_reasons

def _bounds():
    """For each level its floor, the double just below and one between it and the next floor."""
    cases, above, top = [(0.0, SEVERITIES[0]), (math.ulp(0.0), SEVERITIES[1])], None, None
    for name, floor in SEVERITY_FLOORS:
        cases.append((float(floor), name))
        cases.append((floor * 2.0 if above is None else (floor + above) / 2.0, name))
        if top is not None:
            cases.append((math.nextafter(above, 0), name))
        above, top = float(floor), name
    cases.append((math.nextafter(above, 0), SEVERITIES[1]))
    return cases


BOUNDS = _bounds()


def test_level_bounds(spark):
    df = spark.createDataFrame([(s,) for s, _ in BOUNDS], "s double")
    found = df.select("s", severity_of(F.col("s")).alias("level")).collect()
    assert [(r.s, r.level) for r in found] == BOUNDS


@pytest.mark.parametrize(
    "rules,outlier,score,level",
    [
        (3.0, True, 5.0, "High"),
        (0.0, True, 2.0, "Medium"),
        (1.0, False, 1.0, "Low"),
        (11.0, False, 11.0, "Critical"),
        (0.0, False, 0.0, "Normal"),
    ],
)
def test_the_model_adds_its_bonus(spark, rules, outlier, score, level):
    df = spark.createDataFrame([(rules, outlier)], "rule_score double, iso_anomaly boolean")
    row = final_severity(df).first()
    assert (row.severity_score, row.severity) == (score, level)


def test_ranks(spark):
    df = spark.createDataFrame([(s,) for s in [*SEVERITIES, "Odd"]], "s string")
    assert [r[0] for r in df.select(rank_of(F.col("s"))).collect()] == [0, 1, 2, 3, 4, None]
    assert levels_from("High") == ("High", "Critical")
    with pytest.raises(ValueError):
        levels_from("Catastrophic")


def test_reasons_are_joined_or_defaulted(spark):
    df = spark.createDataFrame(
        [(["x", "y"], True), (["x"], False), ([], True), ([], False)],
        "reasons array<string>, outlier boolean",
    )
    model = "Flagged as multivariate outlier by anomaly model"
    both = df.withColumn("reasons", with_model_sentence(F.col("reasons"), F.col("outlier")))
    assert [r.reasons for r in flatten_reasons(both).collect()] == [
        f"x; y; {model}",
        "x",
        model,
        NO_RULE_TEXT,
    ]
