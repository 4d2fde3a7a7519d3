"""From CSV exports to pages, through every step and its files."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from habitus.operators.serving import stats, threats, user_timeline
from habitus.plans.detection import detect, score_days
from habitus.plans.rebuild import build_features, load, prepare_serving, run_detection
from habitus.sources import tables


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Sixty users over fifty days; one exfiltrates at night, one slowly logs on more."""
    data, out = (tmp_path_factory.mktemp(n) for n in ("data", "out"))
    rng = random.Random(4)
    logon, device = ["id,date,user,pc,activity"], ["id,date,user,pc,activity"]

    def line(user, day, hour, pc, activity):
        ts = datetime(2010, 1, 2) + timedelta(days=day, hours=hour, minutes=rng.randrange(60))
        return f"{{X}},{ts:%m/%d/%Y %H:%M:%S},{user},{pc},{activity}"

    for u in range(60):
        user = f"USR{u:04d}"
        for day in range(50):
            count = rng.choice([1, 1, 2]) + (3 if u == 7 and day >= 30 else 0)
            for _ in range(count):
                logon.append(line(user, day, rng.randrange(7, 18), f"PC-{u}", "Logon"))
            logon.append(line(user, day, 18, f"PC-{u}", "Logoff"))
            if rng.random() < 0.2:
                device.append(line(user, day, 12, f"PC-{u}", "Connect"))
                device.append(line(user, day, 13, f"PC-{u}", "Disconnect"))
    for _ in range(6):
        logon.append(line("USR0003", 40, 23, f"PC-{rng.randrange(900)}", "Logon"))
        device.append(line("USR0003", 40, 23, "PC-3", "Connect"))
    device.append(line("GHOST", 5, 3, "PC-1", "Connect"))
    users = ["employee_name,user_id,role,department,team,supervisor,start_date,end_date"]
    users += [f"N,USR{u:04d},Engineer,2 - Research,t{u % 3},s,2009-01-01," for u in range(60)]
    for name, lines in (("logon", logon), ("device", device), ("users", users)):
        (data / f"{name}.csv").write_text("\n".join(lines) + "\n")

    folder = str(out)
    load(spark, str(data), folder)
    build_features(spark, folder)
    summary = run_detection(spark, folder).first()
    layout = prepare_serving(spark, folder, partitions=2).first()
    return folder, summary, layout


def test_every_day_is_scored_once(spark, outputs):
    folder, summary, layout = outputs
    scores = tables.resolve_scores(spark, folder)
    assert summary.user_days == layout.rows == scores.count() == 60 * 50 + 1
    assert scores.select("user", "day").distinct().count() == summary.user_days
    s = stats(scores).first()
    assert (s.total_users, s.total_flagged) == (61, summary.flagged)


def test_the_incident_ranks_first_and_is_explained(spark, outputs):
    top = threats(tables.resolve_scores(spark, outputs[0]), limit=1).results.first()
    assert (top.user, top.day, top.severity) == ("USR0003", "2010-02-11", "Critical")
    assert top.iso_anomaly and top.severity_score == 13.0
    assert [text.split(" unusually")[0] for text in top.reasons.split("; ")] == [
        "off hours logon count",
        "off hours usb count",
        "usb connect count",
        "distinct pcs",
        "logon count",
        "Flagged as multivariate outlier by anomaly model",
    ]


def test_the_slow_rise_drifts(spark, outputs):
    days = user_timeline(tables.resolve_scores(spark, outputs[0]), "USR0007").days.collect()
    assert any(d.drift_flag and "sustained rise in logon count" in d.drift_reasons for d in days)


def test_unknown_user_and_device_only_day(spark, outputs):
    timeline = user_timeline(tables.resolve_scores(spark, outputs[0]), "GHOST")
    day = timeline.days.first()
    assert (day.role, day.logon_count, day.off_hours_usb_count) == ("Unknown", 0.0, 1.0)


def test_the_model_flags_at_most_its_share(spark, outputs):
    scores = spark.read.parquet(f"{outputs[0]}/{tables.SCORE_TABLE}")
    share = scores.agg(F.avg(F.col("iso_anomaly").cast("int"))).first()[0]
    assert 0 < share <= 0.02
    assert scores.where("iso_anomaly <> (iso_score_raw < 0)").count() == 0


def test_detection_is_repeatable_under_any_partitioning(spark, outputs):
    features = spark.read.parquet(f"{outputs[0]}/{tables.FEATURE_TABLE}")
    whole = sorted(map(str, detect(features.coalesce(1)).collect()))
    split = sorted(map(str, detect(features.orderBy(F.rand(2)).repartition(9)).collect()))
    assert whole == split


def test_rows_are_exchanged_and_sorted_once(spark, outputs):
    features = spark.read.parquet(f"{outputs[0]}/{tables.FEATURE_TABLE}")
    plan = score_days(features)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Broadcast" not in plan
    exchanges = [line for line in plan.splitlines() if "Exchange " in line]
    assert len(exchanges) == 2  # the rows, and one combined row per actor
    assert "Python" not in plan
