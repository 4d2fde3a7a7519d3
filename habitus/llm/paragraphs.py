"""Substring deduplication by paragraph MinHash banding.

Paragraphs are the lines of a text, and pieces of ``PIECE`` words from content-defined places on: a
piece begins at a word whose three-word hash is the smallest within ``REACH`` words on either
side. Such places depend on nearby words only, so a passage that is repeated in other surroundings
has the same pieces, wherever its lines are broken.

Each line of at least ``LEAST`` words is a set of five-word shingles. Its MinHash signature is cut
into bands, as many as give ``RECALL`` at the similarity ``SIMILARITY`` (``bands_for``). Lines that
share a band are joined; the exact Jaccard similarity of their shingles must reach
``SIMILARITY``; components of the verified links are the classes. A piece is linked where all of
its words are equal, the case of one band of the whole signature: what is only alike is found
through the lines. So an edited line is repeated if it is 0.8 alike as a whole, and else its
untouched pieces are.

In each document, paragraphs that are repeated and touch or overlap form a run, and each row tells
the words of its run, by which a caller tells a passage from a stock phrase. Runs of fewer than
``RUN_WORDS`` words are left alone, unless ``run_words`` is less: 1 returns every repeated paragraph.
With ``lines`` this holds for
pieces only: every repeated line of at least so many words is returned, in a run or not, so that
``lines=1`` returns all, and with them whole documents of one short line. Lines of fewer than
``SHINGLE`` words are repeated only where they are equal. Of each class the first occurrence left
(by doc_id, then place) stays and all others are removals.

Texts are read twice, once for all paragraphs in narrow rows and once for the shingles of the
lines that share a band with another. Contents are pre-aggregated, so that a passage in a third
of all documents is one row where it is compared. Contents that share a band are compared in
groups of at most two times ``BLOCK``: a band with more is dealt to one group for each pair of its
blocks. Only links that join two trees leave a group.

Cases: null and blank texts never appear, nor do lines of fewer than ``LEAST`` words (or ``lines``); a paragraph that a document repeats is removed from its second occurrence on;
repeated rows of one doc_id are occurrences at the same place, and share one fate; rows with a null doc_id come last in the choice of what stays; empty tables give no rows;
columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitus.llm.bloom import bloom, maybe, sifted
from habitus.llm.components import components
from habitus.llm.store import empty_text, small, store
from habitus.llm.words import mixed, words_of

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.98
ROWS = 2
#: Words of the shortest line that is compared, unless ``lines`` tells.
LEAST = 8
#: Least distance of the beginnings of pieces, and the words of each.
REACH, PIECE = 3, 16
#: Words of the shortest run of repeated paragraphs that counts.
RUN_WORDS = 25
#: Contents compared at once.
BLOCK = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of ``rows`` minima that find a pair of the similarity with probability ``recall``."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


def _times_odd(k: int) -> np.uint64:
    """k times an odd constant, modulo 2**64."""
    return np.uint64(k * int(_ODD) & (1 << 64) - 1)


def _joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words, one for each first word (the last n - 1 are of no use)."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        out[: len(hashes) - k] += mixed(hashes[k:] + _times_odd(k + 1)) if k else mixed(hashes)
    return mixed(out)


def _begins(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Words at which pieces begin; ``text``: the number of the text of each word."""
    n = len(hashes)
    if n < 2 * REACH + 1:
        return np.empty(0, np.int64)
    key = _joined(hashes, 3)
    around = np.lib.stride_tricks.sliding_window_view(key, 2 * REACH + 1)
    found = []
    for k in range(0, len(around), 1 << 18):
        window = around[k : k + (1 << 18)]
        middle = window[:, REACH]
        least = (window[:, :REACH].min(1) > middle) & (window[:, REACH + 1 :].min(1) >= middle)
        found.append(np.flatnonzero(least) + k + REACH)
    at = np.concatenate(found)
    at = at[at + PIECE <= n]
    # The surroundings and the piece lie within the text.
    return at[(text[at - REACH] == text[at + REACH]) & (text[at] == text[at + PIECE - 1])]


def _paragraphs(words, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, first word, end word, whole line) of all lines of ``least`` words, and all pieces."""
    n = len(words.start)
    if not n:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)
    breaks = np.flatnonzero(words.data == 10)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    line = np.searchsorted(breaks, words.start) + text
    starts = np.ones(n, bool)
    starts[1:] = line[1:] != line[:-1]
    lines = np.flatnonzero(starts)
    ends = np.append(lines[1:], n)
    enough = ends - lines >= least
    lines, ends = lines[enough], ends[enough]
    pieces = _begins(text, words.hash)
    first = np.concatenate([lines, pieces])
    end = np.concatenate([ends, pieces + PIECE])
    return text[first], first, end, np.arange(len(first)) < len(lines)


def _contents(words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of all words of each paragraph, in turn."""
    size = end - first
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    own = mixed(words.hash[np.repeat(first, size) + place] + (place + 1).astype(np.uint64) * _ODD)
    check = np.add.reduceat((own ^ (own >> np.uint64(31))) * _times_odd(3), begin)
    return mixed(np.add.reduceat(own, begin)), mixed(check)


def _shingle_rows(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shingles of each paragraph, and where each paragraph's begin among them."""
    size = end - first - (SHINGLE - 1)
    begin = np.cumsum(size) - size
    return np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(begin, size), begin


def _bands(first: np.ndarray, end: np.ndarray, shingles: np.ndarray, bands: int) -> np.ndarray:
    """Band keys (paragraphs x bands)."""
    at, begin = _shingle_rows(first, end)
    own = shingles[at]
    keys = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(first), _times_odd(b + 1))
        for r in range(ROWS):
            odd = np.uint64(2 * int(mixed(np.array([b * ROWS + r + 1], np.uint64))[0]) + 1 & (1 << 64) - 1)
            least = np.minimum.reduceat((own ^ (own >> np.uint64(29))) * odd, begin)
            key = mixed(key ^ least)
        keys[:, b] = key
    return keys


def _once(content: np.ndarray) -> np.ndarray:
    """Places of the first of equal contents."""
    return np.sort(np.unique(content, return_index=True)[1])


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(content, check, doc_id, start, words, whole, bands): all paragraphs of all rows.

    ``content``, ``check``: two hashes of the words; ``start``: first word; ``bands``: band keys of a line that has
    shingles, only at its first occurrence among the rows that a task reads together.
    """
    many = bands_for()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, words in words_of(batch.column(1), plain=True):
                text, first, end, whole = _paragraphs(words, least)
                if not len(first):
                    continue
                content, check = _contents(words, first, end)
                count = np.zeros(len(first), np.int64)
                new = np.flatnonzero(whole & (end - first >= SHINGLE))
                new = new[_once(content[new])]
                count[new] = many
                keys = np.empty((0, many), np.uint64)
                if len(new):
                    keys = _bands(first[new], end[new], _joined(words.hash, SHINGLE), many)
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(content.view(np.int64)),
                        pa.array(check.view(np.int64)),
                        batch.column(0).take(pa.array(start + text)),
                        pa.array(first - words.first[text]),
                        pa.array((end - first).astype(np.int32)),
                        pa.array(whole),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["content", "check", "doc_id", "start", "words", "whole", "bands"],
                )

    kinds = "content long, check long, doc_id long, start long, words int, whole boolean, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), empty_text()).mapInArrow(run, kinds)


def _shared(banded: DataFrame) -> DataFrame:
    """(key, content, place): the distinct contents of every key that has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the key that is open: its last content, and how many went out or wait.
        last_key, last_content, count = None, None, 0
        for batch in batches:
            key, content = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
            if last_key is not None and key[0] == last_key and content[0] == last_content:
                fresh[0] = False
            key, content = key[fresh], content[fresh]
            if not len(key):
                continue
            goes_on = last_key is not None and key[0] == last_key
            if goes_on and count == 1:  # the content that waited has company now
                key, content = np.append(last_key, key), np.append(last_content, content)
                count, goes_on = 0, False
            begins = np.concatenate([[True], key[1:] != key[:-1]])
            starts = np.flatnonzero(begins)
            sizes = np.diff(np.append(starts, len(key)))
            place = np.arange(len(key)) - np.repeat(starts, sizes)
            several = np.repeat(sizes > 1, sizes)
            if goes_on:
                place[: sizes[0]] += count
                several[: sizes[0]] = True
            last_key, last_content = key[-1], content[-1]
            count = int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[several]), pa.array(content[several]), pa.array(place[several])],
                names=["key", "content", "place"],
            )

    ranked = banded.repartition("key").sortWithinPartitions("key", "content")
    return ranked.mapInArrow(run, "key long, content long, place long")


def _shingles(docs: DataFrame, bits: np.ndarray, least: int = LEAST) -> DataFrame:
    """(content, shingles): sorted distinct shingles of the lines that pass a filter of contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in words_of(batch.column(0), plain=True):
                text, first, end, whole = _paragraphs(words, least)
                whole &= end - first >= SHINGLE
                if not whole.any():
                    continue
                first, end = first[whole], end[whole]
                content, _ = _contents(words, first, end)
                new = _once(content)
                new = new[maybe(bits, content[new])]
                if not len(new):
                    continue
                first, end, content = first[new], end[new], content[new]
                at, begin = _shingle_rows(first, end)
                row = np.repeat(np.arange(len(first)), np.diff(np.append(begin, len(at))))
                own = _joined(words.hash, SHINGLE)[at]
                order = np.lexsort((own, row))
                row, own = row[order], own[order]
                fresh = np.ones(len(own), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (own[1:] != own[:-1])
                row, own = row[fresh], own[fresh]
                ends = np.searchsorted(row, np.arange(len(first) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(content.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(own.view(np.int64))),
                    ],
                    names=["content", "shingles"],
                )

    return docs.select(empty_text()).mapInArrow(run, "content long, shingles array<long>")


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of some sets reach the Jaccard similarity (a square table)."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    # Shared members by pairs, from runs of columns so that the table stays small.
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    width = 8192
    for low in range(0, int(code[-1]) + 1, width):
        a, b = np.searchsorted(code, [low, low + width])
        table = np.zeros((len(sets), min(width, int(code[b - 1]) - low + 1)), np.float32)
        table[row[a:b], code[a:b] - low] = 1
        common += table @ table.T
    union = sizes[:, None] + sizes[None, :] - common
    return common >= similarity * union - 1e-6


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a table of links."""
    left, links = np.ones(len(near), bool), []
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root], open_ = False, [root]
        while open_:
            u = open_.pop()
            found = np.flatnonzero(left & near[u])
            left[found] = False
            open_ += found.tolist()
            links += [(u, v) for v in found.tolist()]
    return links


def _verified(groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of each group (key, low, high) of (content, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(left: list[int], right: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
            )

        def compare(names: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
            links = _forest(alike(sets, similarity)) if len(names) > 1 else []
            return [names[u] for u, _ in links], [names[v] for _, v in links]

        group, names, sets = None, [], []
        for batch in batches:
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            contents, lists = batch.column(3).to_pylist(), batch.column(4)
            left, right = [], []
            for k, own in enumerate(ids):
                if own != group:
                    for side, more in zip((left, right), compare(names, sets), strict=True):
                        side += more
                    group, names, sets = own, [], []
                if not names or contents[k] != names[-1]:
                    names.append(contents[k])
                    sets.append(lists[k].values.to_numpy())
            yield out(left, right)
        yield out(*compare(names, sets))

    order = ["key", "low", "high"]
    ranked = groups.repartition(*order).sortWithinPartitions(*order, "content")
    return ranked.select(*order, "content", "shingles").mapInArrow(run, "a long, b long")


def near_lines(
    docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY, least: int = LEAST
) -> DataFrame:
    """(a, b): verified links between contents of the lines among ``found`` occurrences."""
    banded = found.where("size(bands) > 0").select(F.explode("bands").alias("key"), "content")
    shared = store(_shared(banded), "shared")
    crowded = shared.groupBy("key").agg(F.max("place").alias("most")).where(F.col("most") >= BLOCK)
    blocks = F.coalesce(F.floor(F.col("most") / BLOCK), F.lit(0)).cast("int")
    own = F.floor(F.col("place") / BLOCK).cast("int")
    dealt = (
        shared.join(small(store(crowded, "crowded")), "key", "left")
        .select("key", "content", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks)).alias("other"))
        .select("key", "content", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )
    wanted = shared.select("content").distinct()
    sets = _shingles(docs, bloom(wanted, "content"), least)
    sets = sets.join(wanted, "content", "left_semi").dropDuplicates(["content"])
    return _verified(dealt.join(store(sets, "shingles"), "content"), similarity)


def _in_runs(rows: DataFrame, least: int, lines: bool = False) -> DataFrame:
    """Repeated paragraphs of runs of at least ``least`` words; with ``lines``, all whole lines too.

    ``run_words``: the words of the run that each is in.

    A document's paragraphs are put in order by themselves. Without a doc_id they cannot be told
    apart by document, and count each for itself.
    """
    end = F.col("start") + F.col("words")
    before = Window.partitionBy("doc_id").orderBy("start", "words").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("start", "words").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce(F.col("start") > F.max(end).over(before), F.lit(True))
    known = rows.where("doc_id IS NOT NULL").withColumn("_begins", F.when(begins, F.col("start")))
    known = known.withColumn("_run", F.max("_begins").over(upto))
    run = Window.partitionBy("doc_id", "_run")
    known = known.withColumn("run_words", F.max(end).over(run) - F.col("_run"))
    unknown = rows.where("doc_id IS NULL").withColumn("run_words", F.col("words").cast("long"))
    line = F.lit(lines) & F.col("whole")
    found = known.select(*rows.columns, "run_words").unionByName(unknown)
    return found.where(line | (F.col("run_words") >= least))


def duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, run_words: int = RUN_WORDS, lines: int | None = None
) -> DataFrame:
    """(doc_id, start, words, line, class_doc_id, class_start, removed, run_words) of every paragraph
    that occurs more than once, near copies included.

    ``start``, ``words``: its place in words (letters and digits); ``line``: a whole line, else a
    piece; the class is named by the occurrence that stays; ``removed``: all others; ``run_words``: the
    words of the run of repeated paragraphs that it is in. Paragraphs of
    one document may overlap. ``lines``: words from which a repeated whole line is returned
    whatever the run it is in; None holds lines to ``run_words`` as well.
    """
    least = LEAST if lines is None else lines
    found = store(occurrences(docs, least), "paragraphs")
    again = found.groupBy("content").count().where("count > 1").select("content")
    classes = store(components(near_lines(docs, found, similarity, least), "alike"), "classes")
    # Contents without a link are equal where both hashes are, so that none of 10**12 is lost by chance.
    named = (
        again.withColumn("root", F.lit(None).cast("long"))
        .unionByName(classes.withColumnRenamed("node", "content"))
        .groupBy("content").agg(F.coalesce(F.max("root"), F.col("content")).alias("class"), F.max("root").isNull().alias("alone"))
    )
    named = store(named, "named")
    rows = sifted(found.drop("bands"), "content", bloom(named, "content")).join(named, "content")
    rows = rows.withColumn("check", F.when(F.col("alone"), F.col("check")).otherwise(F.lit(0).cast("long")))
    rows = store(_in_runs(rows.drop("content", "alone"), run_words, lines is not None), "members")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "start", "words")
    kept = rows.groupBy("class", "check").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    # Stored, so that the join has plain inputs and a class with very many rows is split.
    kept = small(store(kept.where("n > 1").select("class", "check", "first"), "kept"))
    return rows.join(kept, ["class", "check"]).select(
        "doc_id", "start", F.col("words").cast("long").alias("words"), F.col("whole").alias("line"),
        F.col("first.doc_id").alias("class_doc_id"), F.col("first.start").alias("class_start"),
        (~place.eqNullSafe(F.col("first"))).alias("removed"), "run_words",
    )
