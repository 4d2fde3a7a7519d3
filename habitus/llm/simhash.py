"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

The 64 fingerprint bits are three segments of 23, 23 and 18 bits. Each segment, and each of its
neighbours at one bit, is decoded by the perfect binary Golay code (23, 12, 7) to the index of
its codeword: one to six indices. Two segments that differ in at most two bits share an index.
If fingerprints differ in at most three bits, then by the pigeonhole principle either no segment
has more than two of them, and a triple of indices is shared, or one segment has all three, and
the two others are equal. Triples and pairs are the keys of an equi-join; every candidate is
verified on the full bits, and links are clustered by components.

Work is per distinct fingerprint, so exact copies cost one row. Within a key with many
fingerprints only a spanning tree of the verified links is returned. A key with more than
``HELD`` fingerprints is not gathered: its members are linked through shared neighbours on the
bit cube, which is exact as well and linear in the number of fingerprints.

Cases: a null or blank text has the fingerprint zero and is linked like any other; rows that
repeat a doc_id are one document; rows with a null doc_id are linked by their fingerprints, and
have a null component where no document with an id is reachable; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.llm.components import components
from habitus.llm.store import empty_text, small, store, without_ids

#: Fingerprints of one key that a task compares at once.
HELD = 1024
#: Bits and place of each segment.
SEGMENTS = ((23, 41), (23, 18), (18, 0))
#: Most differing bits that the keys cover.
BITS = 3

# The generator polynomial of the Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
_GENERATOR = 0b110001110101


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, _GENERATOR << (bit - 11), 0)
    return rest


def _errors() -> np.ndarray:
    """The error of at most three bits for each of the 2048 syndromes."""
    patterns = [0] + [sum(1 << b for b in c) for n in (1, 2, 3) for c in combinations(range(23), n)]
    patterns = np.array(patterns)
    table = np.zeros(2048, np.int64)
    table[_syndromes(patterns)] = patterns
    return table


_ERROR = _errors()


def codewords(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords nearest to each word and to its neighbours at one bit.

    Six columns, and which of them count; a perfect code never gives more than six.
    """
    flips = np.concatenate([[0], 1 << np.arange(width)])
    near = words[:, None] ^ flips
    index = np.sort((near ^ _ERROR[_syndromes(words)[:, None] ^ _syndromes(flips)]) >> 11, axis=1)
    fresh = np.ones(index.shape, bool)
    fresh[:, 1:] = index[:, 1:] != index[:, :-1]
    place = np.argsort(~fresh, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(index, place, 1), np.take_along_axis(fresh, place, 1)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned fingerprints, and the row of each."""
    parts = [(prints >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1) for width, at in SEGMENTS]
    (a, use_a), (b, use_b), (c, use_c) = (
        codewords(part, width) for part, (width, _) in zip(parts, SEGMENTS, strict=True)
    )
    triples = a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]
    used = use_a[:, :, None, None] & use_b[:, None, :, None] & use_c[:, None, None, :]
    row = np.broadcast_to(np.arange(len(prints))[:, None, None, None], used.shape)[used]
    keys, rows = [triples[used]], [row]
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)), 1):
        keys.append(k << 60 | parts[i] << 23 | parts[j])
        rows.append(np.arange(len(prints)))
    return np.concatenate(keys), np.concatenate(rows)


def text_print(text: str | None, length: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + length]) for i in range(max(1, len(words) - length + 1))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, length: int = 3) -> DataFrame:
    """(doc_id, bits): the SimHash of each row's words in shingles of ``length``, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([text_print(t.as_py(), length) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"]
            )

    return docs.select(F.col("doc_id").cast("long"), empty_text()).mapInArrow(run, "doc_id long, bits long")


def _keys(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy()
            for k in range(0, len(bits), 2048):
                key, row = keys_of(bits[k : k + 2048].view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(bits[k : k + 2048][row])], names=["key", "bits"]
                )

    return prints.mapInArrow(run, "key long, bits long")


def _tree(bits: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some fingerprints."""
    left = np.ones(len(bits), bool)
    links = []
    for root in range(len(bits)):
        if not left[root]:
            continue
        left[root], open_ = False, [root]
        while open_:
            u = open_.pop()
            found = np.flatnonzero(left & (np.bitwise_count(bits ^ bits[u]) <= most))
            left[found] = False
            open_ += found.tolist()
            links += [(u, v) for v in found.tolist()]
    return links


def _linked(keyed: DataFrame, most: int) -> DataFrame:
    """(a, b, held): verified links within each key, and (a, a, false) for members of large keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: np.ndarray, bits: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
            """Links within whole keys."""
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            sizes = np.diff(cuts)
            left, right = [], []
            two = cuts[:-1][sizes == 2]
            near = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= most]
            left.append(bits[near])
            right.append(bits[near + 1])
            for s, n in zip(cuts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                own = bits[s : s + n]
                if links := _tree(own, most):
                    u, v = np.array(links).T
                    left.append(own[u])
                    right.append(own[v])
            return left, right

        def out(left: list, right: list, held: bool) -> pa.RecordBatch:
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64)), pa.array([held] * pairs.shape[1])],
                names=["a", "b", "held"],
            )

        wait_key, wait_bits, large = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            key = np.concatenate([wait_key, batch.column(0).to_numpy()])
            bits = np.concatenate([wait_bits, batch.column(1).to_numpy().view(np.uint64)])
            if large is not None:  # the rest of a large key passes through
                n = int(np.searchsorted(key, large, "right"))
                if n:
                    yield out([bits[:n]], [bits[:n]], False)
                key, bits = key[n:], bits[n:]
                if not len(key):
                    wait_key, wait_bits = key, bits
                    continue
                large = None
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            big = np.repeat(sizes > HELD, sizes)
            last = starts[-1]
            if big[-1]:
                large = key[-1]
                last = len(key)
            if big.any():
                yield out([bits[big]], [bits[big]], False)
            done = ~big
            done[last:] = False
            if done.any():
                left, right = found(key[done], bits[done])
                if sum(map(len, left)):
                    yield out(left, right, True)
            wait_key, wait_bits = key[last:], bits[last:]
        if len(wait_key):
            left, right = found(wait_key, wait_bits)
            if sum(map(len, left)):
                yield out(left, right, True)

    spread = keyed.repartition("key").sortWithinPartitions("key", "bits")
    return spread.mapInArrow(run, "a long, b long, held boolean")


def _cube(members: DataFrame, most: int) -> DataFrame:
    """Links that keep fingerprints at ``most`` bits connected, through shared points.

    A point within ``most // 2`` bits of f and within ``most - most // 2`` bits of g shows that
    they differ in at most ``most`` bits, and any such f and g share a point. At each point the
    smallest near member is linked to all.
    """
    inner, outer = most // 2, most - most // 2

    def ball(radius: int) -> np.ndarray:
        return np.array(
            [sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(64), n)],
            np.uint64,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = ball(outer)
        close = np.bitwise_count(flips) <= inner
        for batch in batches:
            for k in range(0, len(batch), 256):
                bits = batch.column(0).to_numpy()[k : k + 256].view(np.uint64)
                points = (bits[:, None] ^ flips).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(points.view(np.int64)),
                        pa.array(np.repeat(bits, len(flips)).view(np.int64)),
                        pa.array(np.tile(close, len(bits))),
                    ],
                    names=["point", "bits", "close"],
                )

    points = members.mapInArrow(run, "point long, bits long, close boolean")
    heads = points.where("close").groupBy("point").agg(F.min("bits").alias("head"))
    return points.join(heads, "point").where("bits <> head").select(
        F.col("head").alias("a"), F.col("bits").alias("b")
    )


def links(prints: DataFrame, most: int = BITS) -> DataFrame:
    """(a, b) between distinct fingerprints ``bits``: a set of links at up to ``most`` differing
    bits that connects whatever all such links connect."""
    if not 0 <= most <= BITS:
        raise ValueError(f"the keys cover up to {BITS} differing bits")
    found = store(_linked(_keys(prints), most), "links")
    direct = found.where("held").select("a", "b")
    crowded = store(found.where("NOT held").select(F.col("a").alias("bits")).distinct(), "crowded")
    if crowded.isEmpty():
        return direct
    return direct.unionByName(_cube(crowded, most))


def near_duplicates(docs: DataFrame, length: int = 3, most: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    ``length``: words in a shingle; ``most``: differing bits of a link, 3 at most. The component
    is named by the smallest doc_id that is reachable.
    """
    rows = store(fingerprints(docs, length), "prints")
    # Each fingerprint makes some 150 keys: deal them to all tasks, however few bytes they are.
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = links(rows.select("bits").distinct().repartition(width), most)
    known = rows.where("doc_id IS NOT NULL")
    several = known.groupBy("doc_id").agg(F.min("bits").alias("a"), F.max("bits").alias("z"))
    several = small(store(several.where("a <> z").select("doc_id", "a"), "several"))
    same = known.join(several, "doc_id").select("a", F.col("bits").alias("b"))
    classes = store(components(near.unionByName(same)), "classes")
    own = classes.withColumnRenamed("node", "bits")
    least = (
        known.groupBy("bits").agg(F.min("doc_id").alias("least"))
        .join(own, "bits", "left")
        .withColumn("class", F.coalesce("root", "bits"))
    )
    # Stored, so that the joins have plain inputs and a class with very many rows is split.
    named = store(least.groupBy("class").agg(F.min("least").alias("component_id")), "named")
    # A class for each fingerprint: the ones without links are classes of their own.
    lone = rows.join(own, "bits", "left").withColumn("class", F.coalesce("root", "bits"))
    return lone.join(named, "class", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Column of the numbers of rows.
_ROW = "_row_number"


def deduplicated(docs: DataFrame, length: int = 3, most: int = BITS) -> DataFrame:
    """One row of each group of near-duplicate rows of ``docs``, with all columns.

    Rows are told apart by a number of their own: rows that repeat a doc_id, or have none, are linked
    by their texts as any others. Of a group the row with the smallest doc_id stays (null last), of
    equal ones the one whose text has the smallest md5, of equal texts any one.
    """
    # Stored, so that the number of a row is the same wherever it is read.
    rows = store(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col(_ROW).alias("doc_id"), "text"), length, most)
    groups = store(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "groups")
    several = store(groups.groupBy("_group").count().where("count > 1").select("_group"), "several")
    members = groups.join(small(several), "_group")
    order = F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
        F.md5(empty_text()).alias("hash"), F.col(_ROW).alias("row"),
    )
    ranked = store(
        rows.select(_ROW, order.alias("order")).join(members, F.col(_ROW) == F.col("_row")).select("_row", "_group", "order"),
        "members",
    )
    first = store(ranked.groupBy("_group").agg(F.min("order").alias("first")), "first")
    gone = store(
        ranked.join(small(first), "_group").where(F.col("order.row") != F.col("first.row")).select(F.col("_row").alias(_ROW)),
        "near-duplicates",
    )
    return without_ids(rows, gone, _ROW).drop(_ROW)
