"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over nine neighbouring words that looks at six and ignores three. Test
items and documents are hashed under each mask at every position and joined on the hash, so a
substituted word only hides the positions where every mask looks at it. Around each hit the
words of both texts are compared one by one over every window of ``WINDOW`` words of the item (all
of it, if shorter) that holds the seed; the overlap holds if at least ``SHARE`` of the words of one
are equal.

Native: words, hashes, join and verification are column expressions. The seeds of the test items
are broadcast in blocks of a counted, bounded number of rows; documents are read once for each
block, never shuffled. Only verified overlaps are aggregated.

Cases: null and blank texts, of documents or items, have no words and no overlaps; items shorter
than a mask are looked for as a whole; repeated items are reported by each item_id, repeated
rows of a document as one; rows with a null doc_id or item_id are reported with that null; empty
tables give no rows; other columns are not looked at. ``clean`` decides for each row by itself,
whatever other rows have its doc_id or none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.llm.store import store, without_ids

#: Words looked at (1) and ignored (0).
MASKS = ("110101101", "101110011", "111001011")
WINDOW = 16
SHARE = 0.8
#: Seeds of test items that are broadcast at a time.
BLOCK_ROWS = 200_000

#: Words of a document that are looked at together; runs overlap by the words around a hit.
RUN = 4096

_SPAN = len(MASKS[0])
#: Column of the numbers of rows.
_ROW = "_row_number"


def _words(df: DataFrame, key: str) -> DataFrame:
    """(key, words): hashes of the case-folded words, in order."""
    words = F.split(F.lower(F.col("text").cast("string")), "[^\\p{L}\\p{N}]+")
    words = F.filter(words, lambda w: w != "")
    return df.select(F.col(key), F.transform(words, lambda w: F.xxhash64(w)).alias("words"))


def _seed(mask: str, number: int, words: Column, at: Column) -> Column:
    looked = [F.get(words, at + k) for k, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(number), *looked))


def _runs(df: DataFrame) -> DataFrame:
    """Rows of (doc_id, base, words): bounded runs of a document's words from word ``base`` on.

    Neighbouring runs overlap, so that every hit has all words around it in one of them.
    """
    around = WINDOW + _SPAN
    begin = F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(RUN)))
    rows = df.select("doc_id", "words", begin.alias("begin"))
    base = F.greatest(F.lit(0), F.col("begin") - around)
    return rows.select(
        "doc_id", base.alias("base"), F.slice("words", base + 1, F.lit(RUN + 2 * around)).alias("words")
    )


def _seeds(df: DataFrame, masks: list[tuple[int, str]]) -> DataFrame:
    """All columns of ``df`` with (at, seed) for every mask and position."""
    # An outer explode keeps the planner from computing the words once more for a filter.
    placed = df.select("*", F.posexplode_outer("words").alias("at", "word")).drop("word")
    each = [_seed(mask, number, F.col("words"), F.col("at")) for number, mask in masks]
    return placed.select("*", F.explode_outer(F.array(*each)).alias("seed")).where("seed IS NOT NULL")


def _item_seeds(items: DataFrame) -> tuple[DataFrame, list[tuple[int, str]]]:
    """(item_id, near, back, size, seed) of all items, and the masks; short items have one for their length.

    ``near``: the words of all windows of ``size`` words of the item that hold the seed; ``back``: the
    seed's place there.
    """
    words = store(_words(items, "item_id").withColumnRenamed("words", "item").where("size(item) > 0"), "items")
    short = words.where(F.size("item") < _SPAN).select(F.size("item").alias("n")).distinct().collect()
    masks = list(enumerate(MASKS)) + [(len(MASKS) + r["n"], "1" * r["n"]) for r in short]
    long = _seeds(words.where(F.size("item") >= _SPAN).withColumnRenamed("item", "words"), masks[: len(MASKS)])
    parts = [long] + [
        _seeds(words.where(F.size("item") == len(mask)).withColumnRenamed("item", "words"), [(number, mask)])
        for number, mask in masks[len(MASKS) :]
    ]
    size = F.least(F.lit(WINDOW), F.size("words"))
    beside = size - F.least(F.lit(_SPAN), F.size("words"))
    first = F.greatest(F.lit(0), F.col("at") - beside)
    end = F.least(F.size("words"), F.col("at") + size)
    seeds = reduce(DataFrame.unionByName, parts).select(
        "item_id",
        F.slice("words", first + 1, end - first).alias("near"),
        (F.col("at") - first).alias("back"),
        size.alias("size"),
        "seed",
    )
    return store(seeds, "seeds"), masks


def overlaps(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, window_words, equal_words, doc_word) for each contaminated document and
    item: the best window, and the first of its places in the document."""
    seeds, masks = _item_seeds(items)
    blocks = -(-max(1, seeds.count()) // BLOCK_ROWS)
    placed = _seeds(_runs(_words(docs, "doc_id")), masks)
    cut = F.greatest(F.lit(0), F.col("back") - F.col("at"))  # words of ``near`` before the run
    from_ = F.greatest(F.lit(0), F.col("at") - F.col("back"))
    equal = F.expr("transform(near, (w, k) -> IF(k >= cut AND w = get(here, k - cut), 1, 0))")
    windows = F.expr(
        "transform(sequence(0, size(near) - size), s -> struct(s AS head,"
        " aggregate(slice(equal, s + 1, size), 0, (n, x) -> n + coalesce(x, 0)) AS equal_words))"
    )
    found = []
    for block in range(blocks):
        own = seeds.where(F.pmod("seed", F.lit(blocks)) == block) if blocks > 1 else seeds
        # Rows carry the few words around a hit, not the run. The explode keeps the comparison
        # out of the join, which would otherwise copy the run for each of its words.
        hits = placed.join(F.broadcast(own), "seed").select(
            "doc_id", "item_id", "near", "size", cut.alias("cut"), (F.col("base") + from_).alias("from"),
            F.slice("words", from_ + 1, F.size("near") - cut).alias("here"),
        )
        hits = hits.select("*", F.explode_outer(F.array(equal)).alias("equal"))
        hits = hits.select("doc_id", "item_id", "size", "cut", "from", F.inline_outer(windows))
        hits = hits.withColumn("window_words", F.col("size")).withColumn(
            "doc_word", F.col("from") + F.greatest(F.lit(0), F.col("head") - F.col("cut"))
        )
        found.append(hits.where(F.col("equal_words") >= F.ceil(share * F.col("window_words"))))
    best = F.max(F.struct("equal_words", "window_words", (-F.col("doc_word")).alias("back")))
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("doc_id", "item_id").agg(best.alias("best"))
        .select(
            "doc_id", "item_id",
            F.col("best.window_words").cast("long").alias("window_words"),
            F.col("best.equal_words").cast("long").alias("equal_words"),
            (-F.col("best.back")).cast("long").alias("doc_word"),
        )
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have no overlap with any item, with all their columns."""
    # Stored, so that the number of a row is the same wherever it is read.
    rows = store(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    found = overlaps(rows.select(F.col(_ROW).alias("doc_id"), "text"), items)
    gone = store(found.select(F.col("doc_id").alias(_ROW)).distinct(), "contaminated")
    return without_ids(rows, gone, _ROW).drop(_ROW)
