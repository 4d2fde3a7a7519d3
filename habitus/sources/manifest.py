"""A stored manifest of the clustered table, so that a lookup opens the actor's files by name.

The manifest has a row per file: its path, the least and greatest actor and its row groups, from the
footers. It lies inside the table's folder, where scans of the table pass it over and where rewriting
the table removes it. Within a file the bloom filters and bounds of the row groups do the rest.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from habitus.config import DEFAULTS, Settings
from habitus.sources.footers import read_footers
from habitus.sources.tables import guard_missing

_FOLDER = "_manifest"
#: A manifest of more files stays a table, which a lookup asks instead.
HELD_FILES = 100_000


def write_manifest(spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Write the manifest of the table in ``path`` and return it."""
    found = read_footers(spark, path, settings.actor).where("rows > 0")
    rows = found.select("file", "least", "greatest", "rows", "row_groups", "largest_group")
    rows.sortWithinPartitions("least").write.mode("overwrite").parquet(f"{path}/{_FOLDER}")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    with guard_missing(f"{path}/{_FOLDER}", "write the manifest"):
        return spark.read.parquet(f"{path}/{_FOLDER}")


class ServedTable:
    """A clustered table opened once for many lookups: its schema, and its files by their bounds."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, settings: Settings = DEFAULTS):
        self.spark, self.schema, self.settings = spark, schema, settings
        self.table = read_manifest(spark, path).select("file", "least", "greatest")
        rows = self.table.limit(HELD_FILES + 1).collect()
        self.held = len(rows) <= HELD_FILES
        rows = rows if self.held else []
        #: Files without bounds may hold any actor.
        self.open_files = [r["file"] for r in rows if r["least"] is None]
        self.rows = sorted((r["least"].encode(), r["greatest"].encode(), r["file"]) for r in rows if r["least"] is not None)
        self.least = [r[0] for r in self.rows]
        # The largest upper bound so far: files may overlap, as a heavy actor spans several.
        self.reach: list[bytes] = []
        for _, greatest, _ in self.rows:
            self.reach.append(max(greatest, self.reach[-1]) if self.reach else greatest)

    def files(self, actor: str) -> list[str]:
        """The files that may hold the actor."""
        if not self.held:
            inside = F.col("least").isNull() | ((F.col("least") <= actor) & (F.col("greatest") >= actor))
            return [r["file"] for r in self.table.where(inside).collect()]
        name, found = actor.encode(), list(self.open_files)
        at = bisect_right(self.least, name) - 1
        while at >= 0 and self.reach[at] >= name:
            if self.rows[at][1] >= name:
                found.append(self.rows[at][2])
            at -= 1
        return found

    def lookup(self, actor: str) -> DataFrame:
        """All days of one actor; only its files are opened, and no folder is listed."""
        found = self.files(actor)
        if not found:
            return self.spark.createDataFrame([], self.schema).select(*self.settings.served_columns)
        days = self.spark.read.schema(self.schema).parquet(*found)
        return days.where(F.col(self.settings.actor) == F.lit(actor)).select(*self.settings.served_columns)
