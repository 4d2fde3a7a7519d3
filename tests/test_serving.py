from __future__ import annotations

import json
from datetime import date

import pytest

from habitus.config import SERVED_COLUMNS, SEVERITIES
from habitus.operators import serving

SCHEMA = (
    "user string, day date, role string, department string, team string, severity string, "
    "severity_score double, reasons string, logon_count long, off_hours_logon_count long, "
    "distinct_pcs long, usb_connect_count long, off_hours_usb_count long, iso_anomaly boolean, "
    "drift_flag boolean, drift_reasons string"
)
NONE = "No specific rule triggered"


def row(user, day, severity, score, reasons=NONE, drift="", role="r", department="d"):
    return (
        user, date(2010, 1, day), role, department, "t", severity, score, reasons,
        1, 0, 1, 0, 0, False, bool(drift), drift,
    )


@pytest.fixture(scope="module")
def scores(spark):
    rows = [
        row("ACM2278", 3, "Critical", 11.0, "why A", "slow A"),
        row("ACM2278", 1, "Normal", 0.0, role="first"),
        row("ACM2278", 2, "Normal", 0.0, drift="slow B", role="second"),
        row("abc", 1, "High", 5.0, "why C", department=None),
        row("abc", 2, "Low", 1.0, "why D"),
        row("X.Y", 1, "Medium", 2.0, "why E"),
        row("X.Y", 2, "Normal", 0.0),
        row("zzz", 9, "Medium", 2.0, "why F"),
        (None, date(2010, 1, 5), "r", "d", "t", "Medium", 2.0, "why G", 1, 0, 1, 0, 0, False, False, ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def page(scores, **options):
    found = serving.threats(scores, **options)
    return found.total_matching.first()[0], [(r.user, r.day) for r in found.results.collect()]


def test_stats_add_up(scores):
    s = serving.stats(scores).first()
    assert (s.total_users, s.total_user_days, s.total_flagged) == (4, 9, 6)
    assert sum(s[name.lower()] for name in SEVERITIES) == s.total_user_days
    assert (s.drift_flagged, s.drift_only) == (2, 1)
    assert (s.first_day, s.last_day) == ("2010-01-01", "2010-01-09")
    record = serving.stats_record(scores).first()
    assert set(record.severity_breakdown) == set(SEVERITIES)
    assert record.date_range.start < record.date_range.end


def test_levels_that_do_not_occur_are_zero(scores):
    s = serving.stats(scores.where("severity = 'Low'")).first()
    assert (s.critical, s.low, s.total_user_days) == (0, 1, 1)


def test_run_summary(scores):
    assert tuple(serving.run_summary(scores).first()) == (9, 6, 1)


def test_default_page_is_ranked_and_never_normal(scores):
    total, rows = page(scores)
    assert total == 6
    assert rows == [
        ("ACM2278", "2010-01-03"),
        ("abc", "2010-01-01"),
        (None, "2010-01-05"),
        ("X.Y", "2010-01-01"),
        ("zzz", "2010-01-09"),
        ("abc", "2010-01-02"),
    ]


def test_pages_do_not_overlap(scores):
    everything = page(scores)[1]
    parts = [page(scores, limit=2, offset=o) for o in (0, 2, 4, 6)]
    assert [r for _, rows in parts for r in rows] == everything
    assert {total for total, _ in parts} == {6}


def test_a_deep_page_across_many_cells(spark, scores, monkeypatch):
    """With bounds sampled anew for every job, and no folder to keep anything in."""
    many = scores.where("user = 'abc'").crossJoin(spark.range(700).withColumnRenamed("id", "k"))
    many = many.selectExpr(
        "if(k = 13, null, concat('u', k % 300)) as user",
        *[c for c in scores.columns if c not in ("user", "severity_score", "day")],
        "date_add(day, cast(k as int)) as day",
        "cast(k % 9 as double) as severity_score",
    )
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "5")
    monkeypatch.setattr("habitus.session.scratch_path", lambda *a: pytest.fail("nothing is written"))
    try:
        total, everything = page(many, limit=5000)
        for bounds in (255, 20, 1):
            monkeypatch.setattr(serving, "BOUNDS", bounds)
            for offset in (1, 299, 555, 1300, total - 3, total):
                assert page(many, limit=300, offset=offset) == (total, everything[offset : offset + 300])
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")


def test_the_page_behind_a_row(scores):
    everything = serving.ranked(serving.matching_threats(scores)).collect()
    after = [r for r in everything if r.user is not None]
    for k, r in enumerate(after):
        found = serving.matching_threats(scores.where("user IS NOT NULL"))
        rows = serving.page_after(found, (r.severity_score, r.user, r.day), 3).collect()
        assert [(x.user, x.day) for x in rows] == [(x.user, x.day) for x in after[k + 1 : k + 4]]


def test_min_severity_and_drift(scores):
    assert page(scores, min_severity="High")[0] == 2
    assert page(scores, min_severity="Critical")[1] == [("ACM2278", "2010-01-03")]
    with_drift = page(scores, min_severity="Critical", include_drift=True)[1]
    assert with_drift == [("ACM2278", "2010-01-03"), ("ACM2278", "2010-01-02")]
    assert page(scores, min_severity="Normal")[0] == 7  # a plain Normal day never shows


def test_search_is_a_substring_in_any_case(scores):
    assert page(scores, user="acm")[0] == 1
    assert page(scores, user=".")[0] == 1
    assert page(scores, user="")[0] == 6
    assert page(scores, user="x.y", regex=True)[0] == 1
    assert page(scores, user="^a", regex=True)[0] == 3


def test_department(scores):
    assert page(scores, department="Unknown")[1] == [("abc", "2010-01-01")]
    assert page(scores, department="d")[0] == 5
    assert page(scores, department="")[0] == 6


@pytest.mark.parametrize(
    "options", [{"limit": 0}, {"limit": 5001}, {"offset": -1}, {"min_severity": "Catastrophic"}]
)
def test_bad_parameters(scores, options):
    with pytest.raises(ValueError):
        serving.threats(scores, **options)


def test_record_fields_and_types(scores):
    df = serving.serving_record(scores)
    assert df.columns == list(SERVED_COLUMNS)
    types = dict(df.dtypes)
    assert types["day"] == "string" and types["logon_count"] == "double"
    assert types["drift_flag"] == types["iso_anomaly"] == "boolean"
    record = json.loads(serving.as_json(df.where("user = 'abc'").orderBy("day")).first()[0])
    assert record["department"] == "Unknown" and record["day"] == "2010-01-01"
    assert record["severity_score"] == 5.0 and record["drift_reasons"] == ""


def test_timeline_is_chronological_and_agrees_with_its_header(scores):
    timeline = serving.user_timeline(scores, "ACM2278")
    header, days = timeline.header.first(), timeline.days.collect()
    assert [d.day for d in days] == ["2010-01-01", "2010-01-02", "2010-01-03"]
    assert (header.total_days, header.flagged_days, header.critical, header.normal) == (3, 1, 1, 2)
    assert header.role == "first" and header.any_drift


def test_unknown_user(scores):
    timeline = serving.user_timeline(scores, "NOPE")
    assert timeline.header.count() == timeline.days.count() == 0
    assert tuple(serving.user_found(scores, "NOPE").first()) == ("NOPE", False)
    assert serving.user_found(scores, "zzz").first().found


def test_headers_of_all_users(scores):
    rows = {r.user: r for r in serving.user_headers(scores).collect()}
    assert len(rows) == 5
    assert rows["abc"].department == "Unknown" and rows["abc"].flagged_days == 2
    assert not rows["zzz"].any_drift


def test_flagged_history_is_latest_first(scores):
    rows = serving.flagged_history(scores, "ACM2278").collect()
    assert [r.day for r in rows] == ["2010-01-03", "2010-01-02"]


def test_display_reasons(scores):
    rows = {(r.user, r.day.day): r for r in serving.with_display_reasons(scores).collect()}
    assert rows["ACM2278", 3].table_reason == rows["ACM2278", 3].history_reason == "why A; slow A"
    assert rows["ACM2278", 2].table_reason == rows["ACM2278", 2].history_reason == "slow B"
    assert rows["abc", 1].table_reason == rows["abc", 1].history_reason == "why C"
    assert rows["X.Y", 2].table_reason == NONE and rows["X.Y", 2].history_reason == ""


def test_top_lists(scores):
    assert [r.severity_score for r in serving.top_threats(scores, 2).collect()] == [11.0, 5.0]
    assert serving.top_days(scores, 10).count() == 9
    assert serving.top_threats(scores).count() == 6


def test_compact_base(scores):
    df = serving.compact(serving.threat_base(scores))
    types = dict(df.dtypes)
    assert types["severity_rank"] == "tinyint" and types["severity_score"] == "float"
    assert df.count() == 7


def test_filters_reach_the_scan(spark, scores, tmp_path):
    path = str(tmp_path / "scores")
    scores.write.parquet(path)
    stored = spark.read.parquet(path)
    found = serving.threats(stored, min_severity="High", department="d").results
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(severity, [Critical,High])" in plan or "In(severity, [High,Critical])" in plan
    assert "EqualTo(department,d)" in plan
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
