"""One row per actor and day, from raw logs.

All aggregates combine on the map side before a shuffle, so an actor, a day or a
machine with a large share of the log costs its tasks one row per group. Distinct
machines go through one exchange on (actor, day, machine) and one on (actor, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, Settings
from habitus.functions.times import day_of, is_off_hours

# The activities that count.
LOGON = "Logon"
CONNECT = "Connect"


def _activity_rows(log: DataFrame, activity: str, settings: Settings) -> DataFrame:
    """Rows of one activity with day, hour and off-hours flag.

    Rows without actor or date cannot belong to a group and are left out.
    """
    hour = F.hour("date")
    return log.where(
        (F.col("activity") == activity) & F.col("user").isNotNull() & F.col("date").isNotNull()
    ).select(
        F.col("user").alias(settings.actor),
        day_of(F.col("date")).alias(settings.day),
        "pc",
        hour.alias("hour"),
        is_off_hours(hour, settings).cast("int").alias("off_hours"),
    )


def logon_features(logon: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    rows = _activity_rows(logon, LOGON, settings)
    return rows.groupBy(settings.actor, settings.day).agg(
        F.count(F.lit(1)).alias("logon_count"),
        F.sum("off_hours").alias("off_hours_logon_count"),
        F.count_distinct("pc").alias("distinct_pcs"),
        F.min("hour").alias("first_logon_hour"),
        F.max("hour").alias("last_logon_hour"),
    )


def device_features(device: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    rows = _activity_rows(device, CONNECT, settings)
    return rows.groupBy(settings.actor, settings.day).agg(
        F.count(F.lit(1)).alias("usb_connect_count"),
        F.sum("off_hours").alias("off_hours_usb_count"),
    )


def merge_features(
    logon_days: DataFrame, device_days: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Days of either kind; a missing count is 0, a missing hour stays NULL.

    Both sides come out of their aggregation partitioned by (actor, day), so the
    full outer join adds no exchange.
    """
    joined = logon_days.join(device_days, [settings.actor, settings.day], "full_outer")
    return joined.fillna(0, subset=list(settings.features)).select(
        settings.actor, settings.day, *_measures()
    )


def activity_days(
    logon: DataFrame, device: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """The same rows as ``merge_features`` in one aggregation over both logs.

    Tagging the logs and grouping once needs no join and so no sort of either
    side; this is the path the pipeline takes.
    """
    logons = _activity_rows(logon, LOGON, settings).withColumn("is_logon", F.lit(True))
    connects = (
        _activity_rows(device, CONNECT, settings)
        .withColumn("pc", F.lit(None).cast("string"))
        .withColumn("is_logon", F.lit(False))
    )
    is_logon = F.col("is_logon")

    def off_hours(wanted: Column) -> Column:
        return F.sum(F.when(wanted, F.col("off_hours")).otherwise(0))

    return (
        logons.withColumn("pc", F.col("pc").cast("string"))
        .unionByName(connects)
        .groupBy(settings.actor, settings.day)
        .agg(
            F.count_if(is_logon).alias("logon_count"),
            off_hours(is_logon).alias("off_hours_logon_count"),
            F.count_distinct("pc").alias("distinct_pcs"),
            F.min(F.when(is_logon, F.col("hour"))).alias("first_logon_hour"),
            F.max(F.when(is_logon, F.col("hour"))).alias("last_logon_hour"),
            F.count_if(~is_logon).alias("usb_connect_count"),
            off_hours(~is_logon).alias("off_hours_usb_count"),
        )
    )


def user_context(users: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return users.select(
        F.col("user_id").alias(settings.actor), "role", "department", "team"
    )


def with_context(days: DataFrame, users: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Role, department and team of the actor, NULL for an unknown actor.

    No broadcast is forced: the planner broadcasts the directory only while its
    size is under ``spark.sql.autoBroadcastJoinThreshold`` and else merges. A
    user listed twice gives each of its days twice; see ``repeated_users``.
    """
    return days.join(user_context(users, settings), settings.actor, "left")


def repeated_users(users: DataFrame) -> DataFrame:
    """Users listed more than once, with how often; empty for a sound directory."""
    return (
        users.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("entries"))
        .where(F.col("entries") > 1)
    )


def feature_table(
    logon: DataFrame, device: DataFrame, users: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    days = activity_days(logon, device, settings)
    return with_context(days, users, settings)


def _measures() -> tuple[str, ...]:
    return (
        "logon_count",
        "off_hours_logon_count",
        "distinct_pcs",
        "first_logon_hour",
        "last_logon_hour",
        "usb_connect_count",
        "off_hours_usb_count",
    )
