"""Packing by power-of-two decomposition: pieces of binary lengths, bucketed by length.

A document of n ids is cut into as many pieces of the full length as fit and, for the rest, one
piece for each bit of its length, longest first. Each piece is a sequence of its own, so no
sequence crosses documents, none needs padding, and a bucket holds sequences of one length.

Cases: a null text is empty and gives the end id alone; an empty table gives no rows; repeated
rows (equal ids or texts) are packed one by one, and a repeated or null doc_id is carried as it
is; very long texts are encoded whole; columns other than the two used are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.llm.store import earlier_sums, empty_text, small, store
from habitus.llm.vocab import END_ID, encoder, filled, slices

FULL = 2048


def lengths(n: int, full: int = FULL) -> list[int]:
    """Lengths of the pieces of n ids: the full ones, then the bits of the rest."""
    rest = n % full
    bits = [1 << b for b in range(full.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [full] * (n // full) + bits


def pieces(docs: DataFrame, tokenizer: str, full: int = FULL, ids: bool = False) -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids_crc32, part, place[, ids]) for each piece.

    ``tokenizer``: path of the vocabulary file, the same on every machine. ``full``: a power of
    two. ``ids``: also return the piece's ids, for writers of training files. ``part`` is the
    task's partition and ``place`` the number of pieces of this length before it in the task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part_, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            names = batch.column(0)
            for first, texts in slices(filled(batch.column(1))):
                flat, at = encode(texts)
                rows: list[list] = [[], [], [], [], [], [], []]
                for k in range(len(texts)):
                    own = np.append(flat[at[k] : at[k + 1]], END_ID).astype("<u4")
                    start = 0
                    for length in lengths(len(own), full):
                        part = own[start : start + length]
                        row = (first + k, len(own), start, length, zlib.crc32(part.tobytes()), seen[length], part)
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
                        start += length
                        seen[length] += 1
                columns = [names.take(pa.array(rows[0], pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in rows[1:6]]
                columns.append(pa.array([part_] * len(rows[0]), pa.int32()))
                if ids:
                    ends = np.concatenate([[0], np.cumsum(rows[3])]).astype(np.int32)
                    values = np.concatenate([*rows[6], np.empty(0, "<u4")]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                yield pa.RecordBatch.from_arrays(columns, names=out)

    out = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "place", "part"] + ["ids"] * ids
    schema = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, place long, part int"
    return docs.select(F.col("doc_id").cast("long"), empty_text()).mapInArrow(
        cut, schema + ", ids array<int>" * ids
    )


def pack(docs: DataFrame, tokenizer: str, full: int = FULL, ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    Sequences are numbered without gaps, bucket after bucket from the shortest on, and within a
    bucket as the documents lie in the table. Tasks count the pieces of each length as they
    write them; running sums of these counts (a row for each task and length) give each its first
    number. No piece is sorted or shuffled while the counts are few enough to be broadcast.
    """
    placed = store(pieces(docs, tokenizer, full, ids), "pieces")
    counts = placed.groupBy("length", "part").agg(F.count("*").alias("pieces"))
    numbers = earlier_sums(counts, ("length", "part"), "pieces", "first").select("length", "part", "first")
    return placed.join(small(numbers), ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *["ids"] * ids,
    )
