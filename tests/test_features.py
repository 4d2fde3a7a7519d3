from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from habitus.functions.times import is_off_hours
from habitus.operators.features import (
    activity_days,
    device_features,
    feature_table,
    logon_features,
    merge_features,
    repeated_users,
)

LOG = "date timestamp_ntz, user string, pc string, activity string"
USERS = "user_id string, role string, department string, team string"


def at(hour, minute=0, day=4):
    return datetime(2010, 1, day, hour, minute)


@pytest.fixture
def logon(spark):
    return spark.createDataFrame(
        [
            (at(5, 59), "a", "p1", "Logon"),
            (at(6), "a", "p1", "Logon"),
            (at(19, 59), "a", "p2", "Logon"),
            (at(20), "a", None, "Logon"),
            (at(21), "a", "p3", "Logoff"),
            (at(9, day=5), "a", "p1", "Logon"),
            (at(9), None, "p1", "Logon"),
            (None, "a", "p1", "Logon"),
            (at(23), "b", "p9", "Logoff"),
        ],
        LOG,
    )


@pytest.fixture
def device(spark):
    return spark.createDataFrame(
        [
            (at(10), "a", "p1", "Connect"),
            (at(22), "a", "p1", "Connect"),
            (at(22), "a", "p1", "Disconnect"),
            (at(3), "c", "p4", "Connect"),
        ],
        LOG,
    )


def test_off_hours_bounds(spark):
    hours = spark.range(24).select("id", is_off_hours(F.col("id")).alias("off"))
    assert {r.id for r in hours.collect() if r.off} == {0, 1, 2, 3, 4, 5, 20, 21, 22, 23}


def test_logon_features(logon):
    rows = {(r.user, r.day): r for r in logon_features(logon).collect()}
    assert set(rows) == {("a", date(2010, 1, 4)), ("a", date(2010, 1, 5))}
    first = rows["a", date(2010, 1, 4)]
    assert (first.logon_count, first.off_hours_logon_count, first.distinct_pcs) == (4, 2, 2)
    assert (first.first_logon_hour, first.last_logon_hour) == (5, 20)


def test_device_features(device):
    rows = {r.user: r for r in device_features(device).collect()}
    assert (rows["a"].usb_connect_count, rows["a"].off_hours_usb_count) == (2, 1)
    assert (rows["c"].usb_connect_count, rows["c"].off_hours_usb_count) == (1, 1)


def test_one_pass_equals_the_join(logon, device):
    joined = merge_features(logon_features(logon), device_features(device))
    single = activity_days(logon, device).select(*joined.columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, single.collect()))


def test_device_only_day_has_zero_counts_and_no_hours(logon, device):
    row = activity_days(logon, device).where("user = 'c'").first()
    assert (row.logon_count, row.off_hours_logon_count, row.distinct_pcs) == (0, 0, 0)
    assert row.first_logon_hour is None and row.last_logon_hour is None


def test_context_is_left_joined_and_a_repeated_user_fans_out(spark, logon, device):
    users = spark.createDataFrame(
        [("a", "r", "d", "t"), ("a", "r2", "d2", "t2"), ("z", "r", "d", "t")], USERS
    )
    rows = feature_table(logon, device, users).collect()
    assert sorted((r.user, str(r.day), r.role or "-") for r in rows) == [
        ("a", "2010-01-04", "r"),
        ("a", "2010-01-04", "r2"),
        ("a", "2010-01-05", "r"),
        ("a", "2010-01-05", "r2"),
        ("c", "2010-01-04", "-"),
    ]
    assert [tuple(r) for r in repeated_users(users).collect()] == [("a", 2)]


def test_hot_actor_and_any_partitioning_give_the_same_table(spark):
    rows = spark.range(6000).selectExpr(
        "timestamp_ntz'2010-01-04 00:00:00' + make_dt_interval(0, 0, 0, id * 61) as date",
        "if(id % 3 = 0, 'hot', concat('u', id % 50)) as user",
        "concat('p', id % 7) as pc",
        "'Logon' as activity",
    )
    none = rows.where("false")
    one = activity_days(rows.coalesce(1), none).collect()
    many = activity_days(rows.orderBy(F.rand(3)).repartition(16), none).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
