from __future__ import annotations

import sys
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from habitus.config import FEATURES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("habitus-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "4000")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_days(spark):
    """A feature table from per-actor series of one feature; the others are 0."""

    def build(series: dict[str, list], feature: str = "logon_count", kind: str = "long"):
        rows = [
            (user, date(2020, 1, 1) + timedelta(days=i), value)
            for user, values in series.items()
            for i, value in enumerate(values)
        ]
        df = spark.createDataFrame(rows, f"user string, day date, {feature} {kind}")
        others = [f for f in FEATURES if f != feature]
        return df.selectExpr("*", *[f"cast(0 as {kind}) as {f}" for f in others])

    return build


@pytest.fixture(scope="session")
def make_z(spark):
    """One row with given z-scores, and optionally a baseline."""

    def build(**values):
        row = {f"z_{f}": 0.0 for f in FEATURES} | values
        names = ", ".join(f"{name} double" for name in row)
        return spark.createDataFrame([tuple(row.values())], names)

    return build
