"""CSV logs and the user directory."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitus.functions.times import LOG_FORMAT, lenient_timestamp, strict_timestamp
from habitus.sources.tables import guard_missing

# The columns read from each file.
LOG_COLUMNS = ("date", "user", "pc", "activity")
USER_COLUMNS = (
    "user_id",
    "role",
    "department",
    "team",
    "supervisor",
    "start_date",
    "end_date",
)


def _read_named_columns(spark: SparkSession, path: str, wanted: tuple[str, ...]) -> DataFrame:
    """Columns of a CSV by header name, as text; other columns are not parsed.

    Only the header line is looked at before the job (no type inference). The
    file schema is given in file order and the selection prunes the scan.
    """
    with guard_missing(path, "put the CSV export there"):
        header = spark.read.option("header", True).csv(path).columns
    missing = [name for name in wanted if name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
        .select(*wanted)
    )


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """``date, user, pc, activity`` of a log; a malformed date fails the job."""
    rows = _read_named_columns(spark, path, LOG_COLUMNS)
    return rows.withColumn("date", strict_timestamp(F.col("date")))


class LogScan(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def scan_log_parts(spark: SparkSession, path: str) -> LogScan:
    """The good rows of a log, as ``scan_log`` has them, and apart the lines that are none.

    ``rejects`` (file, line): the text of each line whose date or number of fields is wrong, and the
    file it stands in. Both read the export; store the rejects if they are many.
    """
    with guard_missing(path, "put the CSV export there"):
        header = spark.read.option("header", True).csv(path).columns
    missing = [name for name in LOG_COLUMNS if name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    kinds = {"date": T.TimestampNTZType()}
    fields = [T.StructField(name, kinds.get(name, T.StringType())) for name in header]
    found = (
        spark.read.schema(T.StructType([*fields, T.StructField("_line", T.StringType())]))
        .option("header", True)
        .option("columnNameOfCorruptRecord", "_line")
        .option("timestampNTZFormat", LOG_FORMAT)
        .option("columnPruning", False)
        .csv(path)
    )
    wrong = F.col("_line").isNotNull()
    # Always true: Spark parses a line only if a column of its own is asked for, too.
    parsed = F.length(F.concat_ws("", *LOG_COLUMNS)) >= 0
    return LogScan(
        found.where(~wrong).select(*LOG_COLUMNS),
        found.where(wrong & parsed).select(F.col("_metadata.file_path").alias("file"), F.col("_line").alias("line")),
    )


def reject_counts(rejects: DataFrame) -> DataFrame:
    """(file, lines): rejected lines of each file that has any."""
    return rejects.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


def scan_users(spark: SparkSession, path: str) -> DataFrame:
    """The user directory; a malformed date becomes NULL."""
    rows = _read_named_columns(spark, path, USER_COLUMNS)
    return rows.withColumns(
        {name: lenient_timestamp(F.col(name)) for name in ("start_date", "end_date")}
    )


def write_log_csv(log: DataFrame, path: str) -> None:
    """A log in the CSV form :func:`scan_log` reads, whatever the session zone."""
    day = F.date_format(F.to_date("date"), "MM/dd/yyyy")
    clock = [F.hour("date"), F.minute("date"), F.second("date")]
    (
        log.select(
            F.format_string("%s %02d:%02d:%02d", day, *clock).alias("date"),
            "user",
            "pc",
            "activity",
        )
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )
