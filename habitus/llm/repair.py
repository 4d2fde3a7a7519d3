"""Token ids in grammar-compressed shards (Re-Pair).

Documents are encoded in ascending order of doc_id (nulls first, then by text) and written in
shards of about ``SHARD_IDS`` ids, a row of a Parquet table for each shard: Spark's writer commits
them, so a lost task leaves no half file, and any store that Spark writes to will do.

Within a shard the most frequent pairs of neighbouring symbols are replaced by nonterminals, in
rounds: a round counts all pairs and replaces the ``PAIRS`` most frequent ones that occur at least
``LEAST`` times; later rounds pair nonterminals again. Pairs never reach over the end of a
document: a symbol whose ids end with the end id is never the left one of a pair. The payload of
a shard, all numbers little-endian:

    "RPR1", then uint32: rules, documents, bytes of a symbol (2 or 4)
    rules:      uint32 left, right symbol of each (symbol ``FIRST_RULE`` + k is rule k)
    lengths:    uint32 ids that each rule stands for
    documents:  uint32 first symbol of each document, and the number of symbols
                uint64 ids before each document, and the number of ids
    symbols

A document is decoded from its own symbols; within it, the lengths of the rules lead to any
position without decoding what lies before (``read_range``).

Cases: a null or empty text has the end id alone; repeated rows are written one by one; rows
without an id come first; an empty table gives no shards and no rows; a very long document makes
a shard of its own size; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from habitus.llm.store import empty_text, part_offsets, small, store
from habitus.llm.vocab import END_ID, encoder, filled, slices

SHARD_IDS = 1 << 20
#: First nonterminal; ids of the tokenizer are below.
FIRST_RULE = 49_408
ROUNDS = 3
PAIRS = 4_000
LEAST = 16
_SLOTS = 1 << 18

SHARDS = "part int, shard int, n_docs int, n_ids long, doc_ids array<long>, payload binary"


def compress(ids: np.ndarray, rounds: int = ROUNDS, first: int = FIRST_RULE) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) of a run of ids in which ``END_ID`` ends documents."""
    symbols, rules, top = ids.astype(np.uint32), [], first
    closing = np.zeros(first, bool)  # symbols whose ids end with END_ID
    closing[END_ID] = True
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        left = symbols[:-1]
        pair = left.astype(np.uint64) << np.uint64(32) | symbols[1:]
        slot = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int32)
        slot[closing[left]] = _SLOTS  # not over the end of a document
        count = np.bincount(slot, minlength=_SLOTS + 1)
        count[_SLOTS] = 0
        hot = np.argpartition(-count, PAIRS)[:PAIRS]
        often = np.zeros(_SLOTS + 1, bool)
        often[hot] = count[hot] >= LEAST
        at = np.flatnonzero(often[slot])
        # One pair for each slot; another one that shares the slot waits for the next round.
        held = np.zeros(_SLOTS + 1, np.uint64)
        held[slot[at]] = pair[at]
        at = at[held[slot[at]] == pair[at]]
        count = np.bincount(slot[at], minlength=_SLOTS + 1)
        chosen = np.flatnonzero(count >= LEAST)
        if not len(chosen):
            break
        number = np.zeros(_SLOTS + 1, np.uint32)
        number[chosen] = np.arange(len(chosen), dtype=np.uint32) + np.uint32(top)
        new = number[slot[at]]
        at, new = at[new > 0], new[new > 0]
        names = held[chosen]
        # Of pairs that overlap in a row, every other one is replaced.
        begins = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run = np.flatnonzero(begins)
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at, new = at[place % 2 == 0], new[place % 2 == 0]
        rules.append(np.stack([names >> np.uint64(32), names & np.uint64(0xFFFFFFFF)], 1))
        top += len(chosen)
        closing = np.concatenate([closing, closing[(names & np.uint64(0xFFFFFFFF)).astype(np.int64)]])
        symbols[at] = new
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
    return symbols, np.concatenate(rules).astype(np.uint32) if rules else np.empty((0, 2), np.uint32)


def expansions(rules: np.ndarray, first: int = FIRST_RULE) -> list[np.ndarray]:
    """The ids that each rule stands for."""
    out: list[np.ndarray] = []
    for pair in rules.tolist():
        out.append(np.concatenate([out[s - first] if s >= first else np.array([s], "<u4") for s in pair]))
    return out


def pack(ids: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS) -> bytes:
    """Payload of a shard of ids whose documents end at ``ends``."""
    symbols, rules = compress(ids, rounds)
    lengths = np.ones(FIRST_RULE + len(rules), np.int64)
    for k, (left, right) in enumerate(rules.tolist()):
        lengths[FIRST_RULE + k] = lengths[left] + lengths[right]
    # A document's first symbol is the one at which its ids begin.
    starts = np.concatenate([[0], np.cumsum(lengths[symbols])])
    before = np.concatenate([[0], ends])
    wide = 4 if FIRST_RULE + len(rules) > 1 << 16 else 2
    return b"".join(
        [
            b"RPR1",
            struct.pack("<3I", len(rules), len(ends), wide),
            rules.astype("<u4").tobytes(),
            lengths[FIRST_RULE:].astype("<u4").tobytes(),
            np.searchsorted(starts, before).astype("<u4").tobytes(),
            before.astype("<u8").tobytes(),
            symbols.astype(f"<u{wide}").tobytes(),
        ]
    )


class Shard:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPR1":
            raise ValueError("not a Re-Pair shard")
        count, docs, wide = struct.unpack_from("<3I", payload, 4)
        at = 16

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, n, at)
            at += found.nbytes
            return found

        self.rules = take("<u4", 2 * count).reshape(-1, 2)
        self.lengths = take("<u4", count)
        self.first = take("<u4", docs + 1).astype(np.int64)
        self.before = take("<u8", docs + 1).astype(np.int64)
        self.symbols = take(f"<u{wide}", int(self.first[-1]))
        #: The ids that each symbol stands for, as bytes: one table for plain ids and rules.
        words = expansions(self.rules)
        sizes = np.concatenate([np.ones(FIRST_RULE, np.int64), self.lengths.astype(np.int64)])
        ends = np.concatenate([[0], np.cumsum(4 * sizes)]).astype("<i8")
        flat = np.concatenate([np.arange(FIRST_RULE, dtype="<u4"), *words])
        buffers = [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())]
        self.words = pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers)
        self.sizes = sizes

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of some symbols."""
        if not len(symbols):
            return np.empty(0, "<u4")
        taken = self.words.take(pa.array(symbols))
        return np.frombuffer(taken.buffers()[2], "<u4", int(self.sizes[symbols].sum()))

    def all(self) -> np.ndarray:
        """Ids of all documents, in order."""
        return self.decode(self.symbols)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.decode(self.symbols[self.first[k] : self.first[k + 1]])

    def documents(self) -> list[np.ndarray]:
        """Ids of every document, each from its own first symbol on; one look-up for the whole shard."""
        ids = self.all()
        ends = np.concatenate([[0], np.cumsum(self.sizes[self.symbols])])[self.first]
        return [ids[start:stop] for start, stop in zip(ends[:-1], ends[1:], strict=True)]

    def read_range(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop`` of the k-th document; other symbols are not decoded."""
        own = self.symbols[self.first[k] : self.first[k + 1]]
        ends = np.cumsum(self.sizes[own])
        low = int(np.searchsorted(ends, start, "right"))
        high = int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[low - 1]) if low else 0
        return self.decode(own[low:high])[start - before : max(start, stop) - before]


def write(docs: DataFrame, tokenizer: str, path: str, shard_ids: int = SHARD_IDS) -> None:
    """Write the shards of ``docs`` to ``path``; (part, shard) is their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part, shard = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        waiting: list[np.ndarray] = []
        sizes: list[int] = []

        def out() -> pa.RecordBatch:
            ids = np.concatenate(waiting)
            row = [[part], [shard], [len(names)], [len(ids)], [names], [pack(ids, np.cumsum(sizes))]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(v, k) for v, k in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(
                arrays, names=["part", "shard", "n_docs", "n_ids", "doc_ids", "payload"]
            )

        total = 0
        for batch in batches:
            for first, texts in slices(filled(batch.column(1))):
                flat, at = encode(texts)
                ends = np.cumsum(np.diff(at) + 1)
                ids = np.empty(len(flat) + len(texts), "<u4")
                mark = np.zeros(len(ids), bool)
                mark[ends - 1] = True
                ids[mark], ids[~mark] = END_ID, flat
                starts = ends - (np.diff(at) + 1)
                for k, name in enumerate(batch.column(0).slice(first, len(texts)).to_pylist()):
                    own = ids[starts[k] : ends[k]]
                    names.append(name)
                    waiting.append(own)
                    sizes.append(len(own))
                    total += len(own)
                    if total >= shard_ids:
                        yield out()
                        shard, total = shard + 1, 0
                        names, waiting, sizes = [], [], []
        if names:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), empty_text())
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first()
    ranged = rows.repartitionByRange(width, order).sortWithinPartitions(order, "text")
    ranged.mapInArrow(run, SHARDS).write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, fetched from its own symbols.

    ``start``: ids of all documents before it.
    """
    shards = spark.read.schema(SHARDS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                own = Shard(batch.column(3)[k].as_buffer())
                each = own.documents()
                n = len(each)
                arrays = [
                    pa.array([batch.column(0)[k].as_py()] * n, pa.int32()),
                    pa.array([batch.column(1)[k].as_py()] * n, pa.int32()),
                    batch.column(2).slice(k, 1).flatten(),
                    pa.array(own.before[:-1]),
                    pa.array([len(e) for e in each], pa.int64()),
                    pa.array([zlib.crc32(e.tobytes()) for e in each], pa.int64()),
                ]
                if ids:
                    arrays.append(pa.array([e.astype(np.int32) for e in each], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"] + ["ids"] * ids
    kinds = "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    rows = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(run, kinds + ", ids array<int>" * ids)
    sizes = store(shards.select(F.col("part").alias("_part"), "shard", "n_ids"), "shards")
    earlier = Window.partitionBy("_part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.join(part_offsets(sizes, F.col("n_ids")), "_part").select(
        F.col("_part").alias("part"), "shard",
        (F.col("_base") + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).alias("base"),
    )
    return rows.join(small(store(bases, "bases")), ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids
    )
