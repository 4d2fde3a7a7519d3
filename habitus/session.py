"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows behind an exchange for one task, where the session's shuffle width would give it more.
TASK_ROWS = 500_000


def build_session(app: str = "habitus", **conf: str) -> SparkSession:
    """Session with adaptive execution and a zone-independent clock.

    Master, memory and shuffle width are left to spark-submit.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The cluster's folder for intermediate tables (``spark.checkpoint.dir``).

    Where it is unset, a local session gets a temporary folder; a cluster gets
    None, since no machine-local folder would be visible to all executors.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None and context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="habitus-")
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table inside the shared folder."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` as a table written to the shared folder.

    Unlike a checkpoint the table is columnar, so later steps read only what they use.
    The folder keeps it until it is cleaned, as it keeps checkpoints. A cluster without
    such a folder is an error: recomputing instead would be slow without a word.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession, rows: int) -> int:
    """The session's number of shuffle partitions, or as many more as so many rows need."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


@contextmanager
def wide_enough(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside is shuffled to enough partitions that a task's memory does not grow with the rows."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, shuffle_width(spark, rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parted(df: DataFrame, rows: int, key: str) -> DataFrame:
    """``df``, dealt by ``key`` to more partitions than the session's where so many rows need them."""
    spark = df.sparkSession
    width = shuffle_width(spark, rows)
    return df.repartition(width, key) if width > shuffle_width(spark, 0) else df
