"""The operators' inputs, derived from the sample tables (see TESTDATA.md).

``events`` stands for a logon log, a device log and an access log; ``lineitem`` gives
longer histories, in which drift and the top severity occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _key(events_props: Column) -> Column:
    return F.get_json_object(events_props, "$.k").cast("int")


def _log(spark: SparkSession, folder: str, activities: dict[str, str]) -> DataFrame:
    kind = F.col("event_type")
    activity = F.create_map(*[F.lit(x) for pair in activities.items() for x in pair])[kind]
    return (
        table(spark, folder, "events")
        .where(kind.isin(*activities))
        .select(
            F.col("ts").alias("date"),
            F.col("user_id").cast("string").alias("user"),
            (_key(F.col("props")) % 7).cast("string").alias("pc"),
            activity.alias("activity"),
        )
    )


def logon(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder, {"view": "Logon", "click": "Logon", "signup": "Logoff"})


def device(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder, {"purchase": "Connect", "error": "Disconnect"})


def _places(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey)


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as the directory of the users in ``events``."""
    people = table(spark, folder, "customer")
    places = _places(spark, folder)
    return people.join(places, people.c_nationkey == places.n_nationkey, "left").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_mktsegment").alias("role"),
        F.col("n_name").alias("department"),
        F.col("r_name").alias("team"),
        F.lit(None).cast("string").alias("supervisor"),
        F.when(F.col("c_acctbal") < 0, F.lit("not a date"))
        .otherwise(F.date_format(F.date_add(F.lit("2009-12-31"), F.col("c_nationkey")), "yyyy-MM-dd"))
        .alias("start_date"),
        F.lit(None).cast("string").alias("end_date"),
    )


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as the directory of the actors in ``lineitem``."""
    people = table(spark, folder, "supplier")
    places = _places(spark, folder)
    return people.join(places, people.s_nationkey == places.n_nationkey, "left").select(
        F.col("s_suppkey").cast("string").alias("user_id"),
        F.col("r_name").alias("role"),
        F.col("n_name").alias("department"),
        F.col("s_name").alias("team"),
    )


def shipping_days(spark: SparkSession, folder: str) -> DataFrame:
    """Features per supplier and shipping day; flags of a line stand in for off-hours."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(
            F.col("l_suppkey").cast("string").alias("user"),
            F.to_date("l_shipdate").alias("day"),
        )
        .agg(
            F.count(F.lit(1)).alias("logon_count"),
            F.count_if(F.col("l_returnflag") == "R").alias("off_hours_logon_count"),
            F.count_distinct("l_partkey").alias("distinct_pcs"),
            F.count_if(F.col("l_linestatus") == "O").alias("usb_connect_count"),
            F.count_if(F.col("l_quantity") > 40).alias("off_hours_usb_count"),
        )
    )


def accesses(spark: SparkSession, folder: str) -> DataFrame:
    """Lookups: analysts for some event types, a bare client for the others."""
    named = F.col("event_type").isin("view", "purchase")
    return table(spark, folder, "events").select(
        F.concat(F.lit("10.0.0."), F.col("user_id")).alias("client"),
        F.when(named, F.concat(F.lit("analyst-"), F.col("user_id"))).alias("analyst"),
        _key(F.col("props")).cast("string").alias("user_id"),
        (F.col("event_type") != "error").alias("found"),
        F.col("ts"),
    )


def audit_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same lookups as audit lines, among lines of another event."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    lines = accesses(spark, folder).select(
        F.lit("user_timeline_access").alias("event"),
        stamp.alias("timestamp"),
        "client",
        "analyst",
        "user_id",
        "found",
    )
    return lines.unionByName(lines.withColumn("event", F.lit("other")))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with the headers a client key is made of."""
    kind = F.col("event_type")
    hop = F.concat(F.lit("198.51.100."), F.col("user_id"))
    forwarded = (
        F.when(kind == "view", F.concat(hop, F.lit(", 10.0.0.1, 10.0.0.2")))
        .when(kind == "click", F.concat(F.lit(" "), hop, F.lit(" ,10.0.0.1")))
        .when(kind == "purchase", F.lit(""))
    )
    host = F.when(kind != "error", F.concat(F.lit("203.0.113."), F.col("user_id")))
    return table(spark, folder, "events").select(
        forwarded.alias("forwarded_for"), host.alias("host"), "ts"
    )


def client_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("client"), "ts"
    )
