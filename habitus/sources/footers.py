"""What the footers of a Parquet table tell, as a data source with a partition per file."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, bytes long, rows long, row_groups long, largest_group long, least string, greatest string"
#: Beyond so many files a partition holds several.
PARTITIONS = 10_000


class Footers(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class FooterReader(DataSourceReader):
    """Lists the files once, and reads the tail of each in the task that gets it."""

    def __init__(self, options: dict[str, str]):
        self.path, self.column = options["path"], options.get("column")

    def _store(self) -> tuple[pf.FileSystem, str]:
        return pf.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Footers]:
        store, root = self._store()
        found = [
            (f.path, f.size)
            for f in store.get_file_info(pf.FileSelector(root, recursive=True))
            if f.is_file and f.base_name.endswith(".parquet") and not self._hidden(f.path[len(root):])
        ]
        step = -(-len(found) // PARTITIONS) or 1
        return [Footers(found[k : k + step]) for k in range(0, len(found), step)]

    def _named(self, path: str) -> str:
        """The path as Spark names files: with the store it lies in."""
        parts = urlsplit(self.path)
        if parts.scheme in ("", "file"):
            return f"file:{path}"
        return f"{parts.scheme}://{parts.netloc}/{path.removeprefix(parts.netloc).lstrip('/')}"

    def _hidden(self, path: str) -> bool:
        return any(part.startswith(("_", ".")) for part in path.split("/"))

    def read(self, partition: Footers) -> Iterator[tuple]:
        store, _ = self._store()
        for path, size in partition.files:
            with store.open_input_file(path) as file:
                yield (self._named(path), size, *_facts(pq.ParquetFile(file).metadata, self.column))


def _facts(metadata: pq.FileMetaData, column: str | None) -> tuple:
    """Rows, row groups, rows of the largest group, and bounds of ``column`` where every group has them."""
    groups = [metadata.row_group(k) for k in range(metadata.num_row_groups)]
    facts = (metadata.num_rows, len(groups), max((g.num_rows for g in groups), default=0))
    names = [metadata.schema.column(k).path for k in range(metadata.num_columns)]
    if column not in names or not groups:
        return (*facts, None, None)
    stats = [g.column(names.index(column)).statistics for g in groups]
    if not all(s is not None and s.has_min_max for s in stats):
        return (*facts, None, None)
    return (*facts, str(min(s.min for s in stats)), str(max(s.max for s in stats)))


class FooterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: pa.Schema) -> FooterReader:
        return FooterReader(dict(self.options))


def read_footers(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """One row per file below ``path``: bytes, rows, row groups, and bounds of ``column`` as text.

    Only the end of each file is read. The store is opened by its URI from Python, so it must be
    one that Arrow knows (local, HDFS, S3, GCS, Azure).
    """
    spark.dataSource.register(FooterSource)
    reader = spark.read.format(FooterSource.name()).option("path", path)
    return (reader if column is None else reader.option("column", column)).load()
