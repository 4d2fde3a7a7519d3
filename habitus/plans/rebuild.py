"""The batch steps, from CSV exports to the table readers use.

Each step reads the tables of the step before and writes its own, so a lost job
restarts at its own step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from habitus.config import DEFAULTS, Settings
from habitus.operators.features import feature_table
from habitus.operators.profile import load_summary
from habitus.operators.serving import run_summary, top_threats
from habitus.plans.detection import detect
from habitus.sources.logs import scan_log, scan_users
from habitus.sources.tables import (
    DEVICE_TABLE,
    FEATURE_TABLE,
    LOGON_TABLE,
    PREVIEW_FILE,
    SCORE_TABLE,
    SERVING_TABLE,
    USERS_TABLE,
    layout_totals,
    read_table,
    write_preview,
    write_serving,
    write_table,
)


def load(spark: SparkSession, data: str, out: str) -> dict[str, DataFrame]:
    """Clean the exports ``logon.csv``, ``device.csv`` and ``users.csv``.

    Returns rows and date range of each log, and rows of the directory.
    """
    write_table(scan_log(spark, f"{data}/logon.csv"), f"{out}/{LOGON_TABLE}")
    write_table(scan_log(spark, f"{data}/device.csv"), f"{out}/{DEVICE_TABLE}")
    write_table(scan_users(spark, f"{data}/users.csv"), f"{out}/{USERS_TABLE}")
    return {
        "logon": load_summary(read_table(spark, f"{out}/{LOGON_TABLE}")),
        "device": load_summary(read_table(spark, f"{out}/{DEVICE_TABLE}")),
        "users": load_summary(read_table(spark, f"{out}/{USERS_TABLE}"), "start_date"),
    }


def build_features(spark: SparkSession, out: str, settings: Settings = DEFAULTS) -> DataFrame:
    logon, device, users = (
        read_table(spark, f"{out}/{name}", "run the load step")
        for name in (LOGON_TABLE, DEVICE_TABLE, USERS_TABLE)
    )
    write_table(feature_table(logon, device, users, settings), f"{out}/{FEATURE_TABLE}")
    return read_table(spark, f"{out}/{FEATURE_TABLE}")


def run_detection(spark: SparkSession, out: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Score all days, write them and the ranked preview; returns the run summary."""
    features = read_table(spark, f"{out}/{FEATURE_TABLE}", "run the features step")
    write_table(detect(features, settings), f"{out}/{SCORE_TABLE}")
    scores = read_table(spark, f"{out}/{SCORE_TABLE}")
    write_preview(top_threats(scores, settings=settings), f"{out}/{PREVIEW_FILE}")
    return run_summary(scores)


def prepare_serving(
    spark: SparkSession,
    out: str,
    settings: Settings = DEFAULTS,
    partitions: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Write the clustered table; returns its rows, row groups, files and bytes."""
    scores = read_table(spark, f"{out}/{SCORE_TABLE}", "run the detection step")
    write_serving(scores, f"{out}/{SERVING_TABLE}", settings, partitions, buckets)
    return layout_totals(spark, f"{out}/{SERVING_TABLE}")
