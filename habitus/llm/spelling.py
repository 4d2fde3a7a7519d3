"""Spelling variants: a dictionary of trie-node pairs gives all words at edit distance one.

Every word of the vocabulary is a path in a trie of the words and, read backwards, in a second one, and
the nodes of both are numbered. Leaving out the code point at position i takes a word to the pair (prefix
node of depth i, suffix node behind i); leaving out none, to the pair that meets at i. Words that share a
*skipping* pair differ in the one code point skipped; a word's *meeting* pair that is another word's
skipping pair is that word without one code point. So equal integer pairs are exactly the neighbours, and
no candidate needs a check.

A pair joins at most as many words as the alphabet has letters, and one word that meets there. Each
pair is reduced to counts and its two most frequent words, which tell every member its number of
neighbours and the best one; pairs of words are only written out by ``near_words``. In a run of equal
letters only the first is skipped when a letter is missing, so every neighbour is met once.

Numbering: the words are sorted by ranges, and a word's base is the number of nodes that the words
before it would have without sharing any. A node is its depth more than the base of the first word
below it. A task walks its range in order and keeps the path of the last word; a node that goes on
into further ranges takes the base of the first word of the second one, which the tasks of all its
ranges know from the lengths of what neighbouring ranges share.

Scale: occurrences are counted with map-side combine on the JVM. Words go into the tries as rows with
an array of nodes, so a very long word costs its length, not the square, and a prefix that very many
words share costs no join. The largest table has three numbers for each place of a distinct word.

Cases: null and blank texts have no words; a null doc_id hashes as the empty text; repeated rows are
counted each; equal counts go by code-point order; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.llm.ranges import in_ranges, numbered
from habitus.llm.store import store

# Fixed values of the contract.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
EVERY = 31

#: Letters of words that are looked at together.
BATCH = 1 << 18
#: Members of a pair are numbers: does it meet, then the word, then whether its letter repeats the one before.
_MEETS, _WORD = 1 << 62, (1 << 62) - 1


def runs(docs: DataFrame, least: int = LEAST_LENGTH, every: int | None = EVERY) -> DataFrame:
    """(word): every run of letters with at least ``least`` code points, A-Z in lower case.

    Where ``every`` divides the checksum of doc_id and run, one code point is left out before the
    length is looked at. A run is no shorter than what is left of it, so short ones are passed over.
    """
    low = F.translate("_run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least},}})"))).alias("_run"),
    ).select("_id", low.alias("_run"))
    if every is None:
        return found.select(F.col("_run").alias("word"))
    check = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    place = F.pmod("_check", F.length("_run").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), place), F.expr("substring(_run, CAST(pmod(_check, length(_run)) AS INT) + 2)"))
    word = F.when(F.col("_check") % every == 0, cut).otherwise(F.col("_run"))
    return found.withColumn("_check", check).select(word.alias("word")).where(F.length("word") >= least)


def vocabulary(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n, w): distinct words with at least ``least`` occurrences; w: their rank by falling n, then word."""
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return store(numbered(store(counts, "words"), [F.col("n").desc(), F.col("word")], "w"), "vocabulary")


def shared(a: str, b: str) -> int:
    """Number of letters that two words begin with alike."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least
    low = 0
    while a[low] == b[low]:
        low += 1
    return low


def _borders(ranges: DataFrame) -> dict[int, tuple[int, int, np.ndarray, str | None]]:
    """For each range: its base, the next range's, what the nodes it shares with ranges before are counted
    from (an entry for each depth), and what its last word shares with the next range's first one.

    There are as many ranges as shuffle partitions; two words at a time are looked at.
    """
    rows = ranges.groupBy("_part").agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.sum(F.length("key") + 1).alias("nodes")
    ).orderBy("_part")
    found, base, last, bases, common, inside, before = {}, 0, None, [], [], [], None
    for row in rows.toLocalIterator():
        common.append(-1 if last is None else shared(last, row["first"]))
        if before is not None:
            found[before] = (*found[before][:3], last[: common[-1]])
        bases.append(base)
        # Back over the ranges that lie wholly below a node, and over the one in which it begins.
        inherited, depth = np.empty(common[-1] + 1, np.int64), common[-1] + 1
        for at in range(len(bases) - 1, 0, -1):
            inherited[:depth] = bases[at]
            depth = min(depth, inside[at - 1] + 1, common[at - 1] + 1)
        inside.append(shared(row["first"], row["last"]))
        before, base, last = row["_part"], base + row["nodes"], row["last"]
        found[before] = (bases[-1], base, inherited, None)
    return found


def trie(words: DataFrame, key: Column) -> DataFrame:
    """(w, key, nodes): for each word the numbers of its nodes in the trie of ``key``, from the root on, stored."""
    ranges = in_ranges(words.select("w", key.alias("key")), ["key"], "trie")
    borders = _borders(ranges)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, path, last, base, after, onward = None, [], "", 0, 0, None
        for batch in batches:
            start, flat, ends = 0, [], [0]

            def rows(stop: int) -> pa.RecordBatch:
                nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                own = batch.slice(start, stop - start)
                return pa.RecordBatch.from_arrays([own.column(0), own.column(2), nodes], names=["w", "key", "nodes"])

            words = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for k, (own, word) in enumerate(words):
                if own != part:
                    part = own
                    base, after, inherited, onward = borders[part]
                    path = (inherited + np.arange(len(inherited))).tolist()
                    depth = len(path)
                else:
                    depth = shared(last, word) + 1
                # New nodes count from this word, or from the next range if they go on there.
                through = depth if onward is None else max(depth, shared(onward, word) + 1)
                path = path[:depth] + list(range(after + depth, after + through)) + list(range(base + through, base + len(word) + 1))
                base, last = base + len(word) + 1, word
                flat.extend(path)
                ends.append(len(flat))
                if len(flat) > BATCH:
                    yield rows(k + 1)
                    start, flat, ends = k + 1, [], [0]
            yield rows(batch.num_rows)

    return store(
        ranges.repartition("_part").sortWithinPartitions("_part", "key").select("w", "_part", "key")
        .mapInArrow(walk, "w long, key string, nodes array<long>"),
        "trie",
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (w, key, nodes, back): the skipping pair at each letter, the meeting pairs before and behind each."""
    for batch in batches:
        sizes, start = np.diff(batch.column(2).offsets.to_numpy()) - 1, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), BATCH, "right")) + start)
            part, lengths = batch.slice(start, stop - start), sizes[start:stop]
            points = np.frombuffer("".join(part.column(1).to_pylist()).encode("utf-32-le"), np.uint32)
            ahead, back = (part.column(c).flatten().to_numpy() for c in (2, 3))
            heads = np.cumsum(lengths) - lengths
            trees = heads + np.arange(len(lengths))  # a root more for each word
            own = np.repeat(np.arange(len(lengths)), lengths)
            i = np.arange(len(points)) - heads[own]
            repeats = np.zeros(len(points), bool)
            repeats[1:] = points[1:] == points[:-1]
            repeats &= i > 0
            number = part.column(0).to_numpy() << 1
            both = np.repeat(np.arange(len(lengths)), lengths + 1)
            j = np.arange(len(both)) - trees[both]
            columns = [
                np.concatenate([ahead[trees[own] + i], ahead[trees[both] + j]]),
                np.concatenate([back[trees[own] + lengths[own] - 1 - i], back[trees[both] + lengths[both] - j]]),
                np.concatenate([number[own] | repeats, number[both] | _MEETS]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "suffix", "member"])
            start = stop


def dictionary(vocabulary: DataFrame) -> DataFrame:
    """(prefix, suffix, member): the node pairs of all words."""
    ahead = trie(vocabulary, F.col("word"))
    back = trie(vocabulary, F.reverse("word")).select("w", F.col("nodes").alias("back"))
    return ahead.join(back, "w").select("w", "key", "nodes", "back").mapInArrow(
        _pairs, "prefix long, suffix long, member long"
    )


def _meets() -> Column:
    return F.col("member") >= _MEETS


def _word() -> Column:
    return F.shiftright(F.col("member").bitwiseAND(F.lit(_WORD)), 1)


def _first() -> Column:
    """The skipped letter is not the same as the one before."""
    return F.col("member").bitwiseAND(F.lit(1)) == 0


def best(pairs: DataFrame) -> DataFrame:
    """(w, n_near, f): the number of near words and the most frequent, the smallest of equals.

    Only members of a pair are ever looked at together: those that skip, and the one that meets.
    """
    order = Window.partitionBy("prefix", "suffix").orderBy("member")
    pair = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    skips = ~_meets()
    shown = pairs.select(
        _word().alias("w"), skips.alias("skips"), _first().alias("first"),
        F.count_if(skips).over(pair).alias("_skipping"),
        F.count_if(skips & _first()).over(pair).alias("_missing"),
        F.min(F.when(skips, _word())).over(pair).alias("_top"),
        F.min(F.when(skips & _first(), _word())).over(pair).alias("_top_missing"),
        F.min(F.when(~skips, _word())).over(pair).alias("_met"),
        F.lead(_word()).over(order).alias("_next"),
    )
    other = F.when(F.col("_skipping") > 1, F.when(F.col("w") == F.col("_top"), F.col("_next")).otherwise(F.col("_top")))
    met = F.when(F.col("first"), F.col("_met"))
    near = F.when(F.col("skips"), F.least(other, met)).otherwise(F.col("_top_missing"))
    count = F.when(
        F.col("skips"), F.col("_skipping") - 1 + F.when(met.isNotNull(), 1).otherwise(0)
    ).otherwise(F.col("_missing"))
    return shown.select("w", near.alias("_near"), count.alias("_count")).where("_count > 0").groupBy("w").agg(
        F.sum("_count").alias("n_near"), F.min("_near").alias("f")
    )


def near_words(pairs: DataFrame) -> DataFrame:
    """(a, b): every near word b of every word a, by number; each once."""
    pairs = store(pairs, "node-pairs")
    one = pairs.where(~_meets()).select(_word().alias("a"), _first().alias("first"), "prefix", "suffix")
    two = pairs.select(_word().alias("b"), (~_meets()).alias("skips"), "prefix", "suffix")
    found = one.join(two, ["prefix", "suffix"])
    swapped = found.where("skips AND a <> b").select("a", "b")
    missing = found.where("NOT skips AND first").select("a", "b")
    return swapped.unionByName(missing).unionByName(missing.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(links: DataFrame, most: int, times: int = TIMES) -> DataFrame:
    """(w, root) for every word with a form (w, f), following forms to the last.

    A form is ``times`` times as frequent as its word, so with counts of ``most`` at the highest a chain
    has few steps; each round doubles the steps taken.
    """
    steps = 1
    while times**steps <= most:
        steps += 1
    now = store(links.select("w", F.col("f").alias("root")), "roots")
    taken = 1
    while taken < steps:
        on = now.select(F.col("w").alias("_w"), F.col("root").alias("_root"))
        now = store(
            now.join(on, F.col("root") == F.col("_w"), "left").select("w", F.coalesce("_root", "root").alias("root")),
            "roots",
        )
        taken *= 2
    return now


def variants(words: DataFrame, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every distinct word of ``words`` (word).

    ``form``: the near word of largest n, if that is at least ``times`` the word's own. ``root``: the
    end of the chain of forms from here, the word itself if it has none. ``times`` is 2 or more.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their words")
    known = vocabulary(words, least)
    found = store(best(dictionary(known)), "best")
    forms = known.select(F.col("w").alias("f"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    often = F.col("form_n") >= F.col("n") * times
    found = store(
        known.join(found, "w", "left").join(forms, "f", "left").select(
            "w", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            *[F.when(often, F.col(c)).alias(c) for c in ("f", "form", "form_n")],
        ),
        "forms",
    )
    most = known.agg(F.max("n").alias("n")).first()["n"] or 0
    ends = roots(found.where("f IS NOT NULL"), most, times)
    last = known.select(F.col("w").alias("root"), F.col("word").alias("_root"))
    return (
        found.join(ends, "w", "left").join(last, "root", "left")
        .select("word", "n", "n_near", "form", "form_n", F.coalesce("_root", "word").alias("root"))
    )
