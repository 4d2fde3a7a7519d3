"""A filter of fixed size that drops most rows a join would not find, before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Long words of the filter: one megabyte, whatever the number of keys.
WORDS = 1 << 17


def bloom(keys: DataFrame, key: str) -> np.ndarray:
    """Bits of the (well mixed, long) keys; at most ``WORDS`` rows reach the driver."""
    word = F.col(key).bitwiseAND(F.lit(WORDS - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(key, 17).bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(WORDS, np.uint64)
    if len(rows):
        out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are surely not among those of the filter."""
    keys = keys.view(np.uint64)
    word = bits[(keys & np.uint64(WORDS - 1)).astype(np.int64)]
    return (word >> ((keys >> np.uint64(17)) & np.uint64(63)) & np.uint64(1)).astype(bool)


def sifted(df: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """Rows of ``df`` whose key may be among those of the filter."""
    place = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe(bits, batch.column(place).to_numpy())))

    return df.mapInArrow(run, df.schema)
