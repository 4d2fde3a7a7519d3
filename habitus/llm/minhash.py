"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once. The upper bits of the hash choose one of ``BINS``
bins, and a bin keeps the smallest hash that falls into it. A bin that stays empty takes the
value of the first non-empty bin in a pseudo-random order of its own (optimal densification:
empty bins borrow independently of each other, and the order does not depend on the text). The
fingerprint packs the low ``BITS`` bits of every bin as hexadecimal digits. Two bins agree by
chance with probability 2**-BITS; the likeness corrects for that.

Native: hashing, binning, densification and comparison are column expressions within a row, so
no shingle is ever shuffled.

Cases: a null text is empty; a text without words has the empty fingerprint, which is like
another empty one (1) and unlike any other (0); fewer than five words are one shingle; repeated
rows are fingerprinted one by one; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.llm.ranges import in_ranges
from habitus.llm.store import empty_text, store

BINS = 128
BITS = 8
SHINGLE = 5
#: Code points of a text that choose its range beside doc_id.
PREFIX = 64

_SHIFT = 64 - BINS.bit_length() + 1
_LOW = (1 << BITS) - 1


def _bin(x: Column) -> Column:
    """Bin of a hash; ascending with the signed hash."""
    return F.shiftright(x, _SHIFT) + BINS // 2


def with_codes(df: DataFrame, text: str, codes: str) -> DataFrame:
    """``df`` with ``codes``: the low bits of each bin of the text, an empty array without words."""
    words = F.filter(F.split(F.lower(F.col(text)), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    step = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    last = F.size("_words") - (SHINGLE - 1)
    shingles = F.when(
        last >= 1,
        F.transform(
            F.slice("_words", F.lit(1), F.greatest(last, F.lit(1))),
            lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, SHINGLE)]),
        ),
    ).otherwise(F.array(F.xxhash64("_words")))
    step = step.withColumn("_hashes", F.when(F.size("_words") > 0, F.sort_array(shingles)))
    least = F.filter(
        F.col("_hashes"),
        lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("_hashes", F.greatest(i - 1, F.lit(0))))),
    )
    step = step.withColumn("_least", least)
    step = step.withColumn("_bins", F.transform("_least", lambda x: _bin(x).cast("int")))

    def code(j: Column) -> Column:
        at = F.array_position("_bins", j.cast("int"))
        borrowed = F.array_min(
            F.transform(
                F.col("_least"),
                lambda x: F.xxhash64(j, _bin(x)).bitwiseAND(F.lit(~_LOW)).bitwiseOR(x.bitwiseAND(F.lit(_LOW))),
            )
        )
        own = F.get("_least", (at - 1).cast("int"))
        return F.when(at > 0, own).otherwise(borrowed).bitwiseAND(F.lit(_LOW))

    full = F.transform(F.col("_least"), lambda x: x.bitwiseAND(F.lit(_LOW)))
    sparse = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), code)
    value = F.when(F.size("_least") == BINS, full).when(F.size("_least") > 0, sparse)
    none = F.expr("array()").cast("array<bigint>")
    return step.withColumn(codes, F.coalesce(value, none)).drop("_words", "_hashes", "_least", "_bins")


def packed(codes: Column) -> Column:
    """Codes as hexadecimal digits, ``BITS`` / 4 for each bin."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles from two arrays of codes, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(BINS)
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(corrected)


def _ranged(docs: DataFrame) -> DataFrame:
    """(range, guest, doc_id, text): the rows such that each one's successor is in its range.

    Rows in the order of doc_id, nulls first, then text; after the last comes the first. Rows are
    dealt out by ranges of doc_id and the first ``PREFIX`` code points, which is the same order, so
    that rows without a doc_id, or repeating one, are many ranges as well. The first row of each
    range is also sent to the range before it; there are as many ranges as shuffle partitions, and
    their list stays in Spark.
    """
    rows = docs.select(F.col("doc_id").cast("long"), empty_text())
    rows = rows.withColumn("prefix", F.substring("text", 1, PREFIX))
    parts = in_ranges(rows, [F.col("doc_id").asc_nulls_first(), "prefix"], "ranges").withColumnRenamed("_part", "range")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "prefix")
    # Equal keys share a range, so the least key of a range is in no other one.
    heads = store(parts.groupBy("range").agg(F.min(key).alias("head")), "heads")
    every = Window.orderBy("range")
    last = F.max("range").over(Window.partitionBy())
    sent = heads.select(F.coalesce(F.lag("range").over(every), last).alias("to"), "head.doc_id", "head.prefix")
    sent = sent.select("to", F.col("doc_id").alias("_id"), F.col("prefix").alias("_prefix"))
    guests = (
        parts.join(F.broadcast(sent), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("prefix") == F.col("_prefix")))
        .groupBy("to").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))
    )
    return parts.select("range", F.lit(False).alias("guest"), "doc_id", "text").unionByName(
        guests.select(F.col("to").alias("range"), F.lit(True).alias("guest"), "doc_id", "text")
    )


def compared(docs: DataFrame) -> DataFrame:
    """For each row: its fingerprint, its edited text's, and how alike they and its successor's are.

    The edited text is the text with its last half (rounded down, in code points) replaced by as
    many first code points of the next row's text, or by all of it.
    """
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    rows = _ranged(docs).withColumn("next_text", F.lead("text").over(order))
    rows = with_codes(rows, "text", "codes").withColumn("next_codes", F.lead("codes").over(order))
    rows = rows.where("NOT guest")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half)
    )
    rows = rows.withColumn("edited", edited).drop("next_text")
    rows = with_codes(rows, "edited", "edited_codes")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("codes")).alias("fingerprint"),
        packed(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row."""
    return with_codes(docs.select("doc_id", empty_text()), "text", "codes").select(
        "doc_id", packed(F.col("codes")).alias("fingerprint")
    )
