"""Stage tables in Parquet, the layout for lookups, and small CSV reports."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from habitus.config import DEFAULTS, PREVIEW_COLUMNS, Settings
from habitus.sources import generations
from habitus.sources.footers import read_footers

# Table names inside an output folder.
LOGON_TABLE = "logon"
DEVICE_TABLE = "device"
USERS_TABLE = "users"
FEATURE_TABLE = "actor_days"
SCORE_TABLE = "scored_days"
SERVING_TABLE = "serving"
PREVIEW_FILE = "preview_csv"

_BUCKET_PREFIX = "actor_bucket_of_"


class MissingSource(FileNotFoundError):
    """An input table is not there; the message names the step that makes it."""


@contextmanager
def guard_missing(path: str, remedy: str) -> Iterator[None]:
    try:
        yield
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingSource(f"Missing {path}: {remedy}.") from error


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(
    spark: SparkSession,
    path: str,
    remedy: str = "run the step before",
    schema: StructType | None = None,
) -> DataFrame:
    """A stored table. A known ``schema`` saves the job that reads it from a footer."""
    with guard_missing(path, remedy):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)


def write_days(df: DataFrame, path: str, settings: Settings = DEFAULTS) -> None:
    """Write rows into a folder per day; only the days that ``df`` has are replaced.

    Days are cut by ranges of (day, actor), so that a day of very many rows is several tasks. Spark
    writes into a staging folder and swaps the folders of the days at the end: a lost job changes none.
    """
    keys = [settings.day, settings.actor]
    (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(settings.day)
        .parquet(path)
    )


def _bucket(actor: Column, buckets: int) -> Column:
    """Checksum bucket of an actor; ``_bucket_number`` gives the same without a job."""
    return (F.crc32(actor) % buckets).cast("int")


def _bucket_number(actor: str, buckets: int) -> int:
    return zlib.crc32(actor.encode()) % buckets


def write_serving(
    scores: DataFrame,
    path: str,
    settings: Settings = DEFAULTS,
    partitions: int | None = None,
    buckets: int | None = None,
) -> None:
    """The served columns, clustered so that one actor is one short range.

    Range partitioning on (actor, day) rather than on the actor alone lets a
    heavy actor span several files; the statistics of the small row groups then
    let a lookup skip all others. Within bounds a group is skipped by its dictionary of actors, or
    by a bloom filter where there are too many for one. ``partitions`` None leaves the width to the
    session and to adaptive execution.

    A table of very many files should also set ``buckets``: actors are then hashed
    into that many folders, and a lookup given the same number lists and opens one
    folder instead of all. The number is part of the folder name, so a lookup with
    another one finds no folder instead of the wrong one.
    """
    keys = [settings.actor, settings.day]
    served = scores.select(*settings.served_columns)
    if buckets:
        folder = f"{_BUCKET_PREFIX}{buckets}"
        served = served.withColumn(folder, _bucket(F.col(settings.actor), buckets))
        keys.insert(0, folder)
    width = () if partitions is None else (partitions,)
    writer = (
        served.repartitionByRange(*width, *keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", settings.row_group_rows)
        .option(f"parquet.bloom.filter.enabled#{settings.actor}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{settings.actor}", settings.row_group_rows)
    )
    if buckets:
        writer = writer.partitionBy(keys[0])
    writer.parquet(path)


def read_served(
    spark: SparkSession,
    path: str,
    settings: Settings = DEFAULTS,
    schema: StructType | None = None,
) -> DataFrame:
    table = read_table(spark, path, "run the detection step", schema)
    return table.select(*settings.served_columns)


def resolve_path(spark: SparkSession, folder: str) -> str:
    """The clustered table if it was written, else the table of the detection run."""
    for name in (SERVING_TABLE, SCORE_TABLE):
        path = f"{folder}/{name}"
        try:
            read_table(spark, path, "run the detection step")
        except MissingSource:
            if name == SCORE_TABLE:
                raise
        else:
            break
    return path


def resolve_scores(spark: SparkSession, folder: str, settings: Settings = DEFAULTS) -> DataFrame:
    return read_served(spark, resolve_path(spark, folder), settings)


def lookup(
    spark: SparkSession,
    path: str,
    actor: str,
    settings: Settings = DEFAULTS,
    buckets: int | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """All days of one actor; the equality is pushed into the Parquet scan.

    A reader that keeps the table's ``schema`` (that of ``read_served``) is spared a job.

    With ``buckets``, as given to ``write_serving``, only the actor's folder is listed
    and read. Where that folder does not exist the whole table is searched.
    """
    table = None
    if buckets:
        folder = f"{path}/{_BUCKET_PREFIX}{buckets}={_bucket_number(actor, buckets)}"
        try:
            table = read_table(spark, folder, schema=schema)
        except MissingSource:
            table = None
    if table is None:
        table = read_table(spark, path, "run the detection step", schema)
    return table.where(F.col(settings.actor) == F.lit(actor)).select(*settings.served_columns)


def layout_report(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, rows and row groups of each file (by its path), as they were written.

    A task reads the end of its files only.
    """
    if not generations.names(spark, path):
        raise MissingSource(f"Missing {path}: write the serving layout.")
    return read_footers(spark, path).select("file", "bytes", "rows", "row_groups", "largest_group")


def layout_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: rows, row groups, files and bytes of a clustered table."""
    return layout_report(spark, path).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("row_groups"), F.lit(0)).alias("row_groups"),
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def write_preview(top: DataFrame, path: str) -> None:
    """The short ranked list as one CSV part; its length is the list's own limit."""
    (
        top.select(*PREVIEW_COLUMNS)
        .coalesce(1)
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )
