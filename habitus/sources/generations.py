"""A stored table that grows by whole generations, the newest committed one of which counts.

A generation is a folder ``generation=<name>``; Spark's writer puts its success marker there when
all of it is in place. What a lost job left behind has no marker, is never read, and is overwritten
when the step is repeated. Names sort as text, so numbers are written at a fixed width. There is
one writer; a reader that opened the generation before the newest can finish reading it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "generation="


def _store(spark: SparkSession, path: str):
    """The file system of ``path`` and its path class, whatever store it is."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders or files that match, sorted."""
    files, kind = _store(spark, pattern)
    return sorted(f.getPath().getName() for f in files.globStatus(kind(pattern)) or [])


def remove(spark: SparkSession, path: str) -> None:
    files, kind = _store(spark, path)
    files.delete(kind(path), True)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the generations that are whole, oldest first."""
    files, kind = _store(spark, path)
    found = files.globStatus(kind(f"{path}/{_PREFIX}*/_SUCCESS")) or []
    return sorted(f.getPath().getParent().getName().removeprefix(_PREFIX) for f in found)


def latest(spark: SparkSession, path: str) -> str | None:
    return next(reversed(committed(spark, path)), None)


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_PREFIX}{name}")


def write(df: DataFrame, path: str, name: str, keep: int = 2) -> DataFrame:
    """``df`` as generation ``name``, read again; all but the newest ``keep`` are removed then."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/{_PREFIX}{name}")
    whole = committed(spark, path)
    for old in whole[:-keep]:
        remove(spark, f"{path}/{_PREFIX}{old}")
    return read(spark, path, name)
