from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from habitus.config import RULE_WEIGHTS
from habitus.functions.text import one_decimal, whole_number
from habitus.operators.baseline import zscores
from habitus.operators.rules import ceilings, rule_scores


def test_threshold_is_strict(make_z):
    row = rule_scores(make_z(z_logon_count=2.5)).first()
    assert (row.rule_score, row.reasons) == (0, [])


@pytest.mark.parametrize("feature,weight", RULE_WEIGHTS)
def test_each_rule_has_its_weight(make_z, feature, weight):
    assert rule_scores(make_z(**{f"z_{feature}": 3.5})).first().rule_score == weight


def test_rules_add_up_in_a_fixed_order(make_z):
    row = rule_scores(
        make_z(z_logon_count=5.0, z_off_hours_usb_count=5.0, z_off_hours_logon_count=5.0)
    ).first()
    assert row.rule_score == 7
    assert [r.split(" unusually")[0] for r in row.reasons] == [
        "off hours logon count",
        "off hours usb count",
        "logon count",
    ]


def test_sentence_without_a_baseline(make_z):
    row = rule_scores(make_z(z_off_hours_usb_count=4.2)).first()
    assert row.reasons == ["off hours usb count unusually high for this user (z=4.2)"]


def test_sentence_with_a_baseline(make_z):
    row = rule_scores(
        make_z(z_off_hours_usb_count=4.2, mean_off_hours_usb_count=2.0, std_off_hours_usb_count=1.0)
    ).first()
    assert row.reasons == [
        "off hours usb count unusually high for this user (z=4.2)"
        " — would not flag below 4.5 (actual: 6)"
    ]


@pytest.mark.parametrize("std", [0.0, None])
def test_no_counterfactual_without_spread(make_z, std):
    row = rule_scores(
        make_z(z_off_hours_usb_count=4.2, mean_off_hours_usb_count=2.0, std_off_hours_usb_count=std)
    ).first()
    assert "would not flag" not in row.reasons[0]


def test_numbers_read_as_python_prints_them(spark):
    values = [2.25, 0.25, 0.15, 2.5, 0.5, 1.5, 4.5, 1.05, 1234.25, 0.0, -0.04, 1e-9, 12345678.95]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", one_decimal(F.col("v")).alias("a"), whole_number(F.col("v")).alias("b")).collect():
        assert (row.a, row.b) == (f"{row.v:.1f}", f"{row.v:.0f}")


def test_reasons_match_a_plain_recomputation(make_days):
    series = {f"u{i}": [1 + (k * i) % 3 for k in range(30)] + [9 + i] for i in range(8)}
    weights = dict(RULE_WEIGHTS)
    rows = rule_scores(zscores(make_days(series))).collect()
    assert any(r.reasons for r in rows)
    for r in rows:
        expected, score = [], 0
        for name in weights:
            z, mean, std = r[f"z_{name}"], r[f"mean_{name}"], r[f"std_{name}"]
            if z > 2.5:
                score += weights[name]
                expected.append(
                    f"{name.replace('_', ' ')} unusually high for this user (z={z:.1f})"
                    f" — would not flag below {mean + 2.5 * std:.1f} (actual: {mean + z * std:.0f})"
                )
        assert (r.rule_score, r.reasons) == (score, expected)


def test_ceiling_is_where_the_rule_stops(make_days):
    row = ceilings(zscores(make_days({"u": [2, 4, 6, 8, 10]}))).first()
    assert row.ceiling_logon_count == pytest.approx(6 + 2.5 * 10**0.5)
