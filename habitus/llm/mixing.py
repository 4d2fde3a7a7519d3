"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in a shuffled queue, by the md5 of seed, doc_id and text, and the
queue is run through up to ``repeats`` times. A copy's virtual finish time is the number of words
of its source up to its end, earlier rounds included, divided by the source's target. All copies of
all sources are sorted by finish time and the mix is the longest beginning whose words do not exceed
the budget. Every source then holds its target up to the document in which the cut falls, and the
order of finish times interleaves the sources in proportion to their weights.

Targets: each source gets its weight's share of the budget, but at most ``repeats`` times its size;
the excess is shared by weight among the others until none is above.

Scale: texts are read once, for size and key. Narrow rows are range-partitioned by (source, key), so
that a source with a third of all rows is many ranges; running sums add the totals of earlier ranges
to those within one. Copies are range-partitioned by finish time, and only the range in which the
budget ends is looked at row by row. What reaches the driver are single rows: sums of the sources
and the last copy of the mix.

Cases: a null or blank text has size 0 and takes nothing; a null source is a source, the last; a null
doc_id is carried as it is; repeated rows are rows of their own, which stand next to each other in
the queue; ties in finish time go by key, source and round; an empty table gives no rows; columns
other than doc_id, text and source are not looked at; sources without a weight get nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.llm.ranges import before_ranges, in_ranges, numbered
from habitus.llm.store import small, store

#: A run of characters other than ASCII white space is a word.
WORD = r"[^\x20\x09-\x0D]+"
#: A document stands in the mix so many times at most.
REPEATS = 3


def key_of(seed: str = "") -> Column:
    """The key by which a queue is shuffled."""
    parts = [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))]
    return F.md5(F.concat(*parts, F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))))


def sizes(docs: DataFrame, seed: str = "") -> DataFrame:
    """(doc_id, source, size, key), stored; the only pass over the texts."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return store(docs.select("doc_id", "source", size.alias("size"), key_of(seed).alias("key")), "sizes")


def cycled_weights(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): the weights in turn for the sources in code-point order, null last."""
    order = [F.col("source").asc_nulls_last()]
    places = numbered(store(sized.select("source").distinct(), "sources"), order, "_place")
    values = F.array(*[F.lit(float(w)) for w in weights])
    return places.select("source", F.get(values, F.pmod("_place", F.lit(len(weights))).cast("int")).alias("weight"))


def targets(sized: DataFrame, weights: DataFrame, budget: int | None = None, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) for every source, stored. Without ``budget``: all words.

    The shares rise from round to round, so the sources at their bound in one round are those whose
    bound is below their share of the round before; each round is one sum over the sources.
    """
    wanted = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = store(
        sums.join(wanted, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"),
            (F.col("source_size") * repeats).alias("bound"),
        ),
        "sources",
    )
    total = found.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    budget = (total["words"] or 0) if budget is None else budget
    rest, weight, full = budget, total["weight"] or 0.0, -1

    def share() -> Column:
        return F.lit(float(rest)) * F.col("weight") / F.lit(weight) if weight else F.lit(0.0)

    while weight:
        above = F.col("bound") < share()
        row = found.agg(
            F.count_if(above).alias("full"), F.sum(F.when(above, F.col("bound"))).alias("bound"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if row["full"] == full:
            break
        full, left = row["full"], row["weight"] or 0.0
        if not left:  # every source is at its bound
            return _with_target(found, F.when(F.col("weight") > 0, F.col("bound").cast("double")).otherwise(0.0))
        rest, weight = budget - (row["bound"] or 0), left
    return _with_target(found, F.least(F.col("bound").cast("double"), share()))


def _with_target(sources: DataFrame, target: Column) -> DataFrame:
    return store(sources.select("source", "source_size", target.alias("target")), "targets")


def _finish(round_: Column | int) -> Column:
    """Virtual finish time of a row's copy in a round from 1 on."""
    passed = (F.lit(round_) if isinstance(round_, int) else round_) - 1
    return (passed * F.col("source_size") + F.col("queue_end")) / F.nullif(F.col("target"), F.lit(0.0))


def _order(round_: Column | int) -> Column:
    """What the mix is sorted by."""
    number = F.lit(round_) if isinstance(round_, int) else round_
    return F.struct(_finish(round_).alias("finish"), "key", "source", number.cast("int").alias("round"))


def _last(copies: DataFrame, budget: int):
    """The last copy of the mix, or None if it holds none."""
    parts = in_ranges(copies, ["place"], "copies")
    ranges = before_ranges(parts, F.col("size"))
    whole = ranges.where(F.col("_before") + F.col("_total") <= budget).select("_part")
    split = ranges.where((F.col("_before") < budget) & (F.col("_before") + F.col("_total") > budget))
    inside = parts.join(F.broadcast(split.select("_part", "_before")), "_part")
    running = F.sum("size").over(Window.partitionBy("_part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    begun = inside.select("place", (F.col("_before") + running).alias("_sum")).where(F.col("_sum") <= budget)
    ends = parts.join(F.broadcast(whole), "_part").select("place").unionByName(begun.select("place"))
    return ends.agg(F.max("place").alias("place")).first()["place"]


def mix(
    docs: DataFrame, weights: DataFrame | None = None, budget: int | None = None, repeats: int = REPEATS, seed: str = ""
) -> DataFrame:
    """Each row of ``docs`` as the mix takes it.

    (doc_id, source, key, size, source_size, target, queue_end, copies, taken): ``queue_end`` words
    stand in the source's queue up to the row's end, ``copies`` times the row stands in the mix, and
    ``taken`` words with all copies. ``weights``: (source, weight); without it 1, 2, 3 in turn.
    """
    sized = sizes(docs, seed)
    weights = cycled_weights(sized) if weights is None else weights
    sources = targets(sized, weights, budget, repeats)
    if budget is None:
        budget = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    queue = in_ranges(sized, [F.col("source"), F.col("key")], "queue")
    named = sources.select(F.col("source").alias("_source"), "source_size", "target")
    ranges = before_ranges(queue, F.col("size"), ("source",)).join(
        named, F.col("source").eqNullSafe(F.col("_source"))
    )
    ranges = store(
        ranges.select(F.col("source").alias("_source"), F.col("_part").alias("_range"), "_before", "source_size", "target"),
        "ranges",
    )
    within = Window.partitionBy("_part", "source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_range"))
    placed = store(
        queue.join(small(ranges), same).select(
            "doc_id", "source", "key", "size", "source_size", "target",
            (F.col("_before") + F.sum("size").over(within)).alias("queue_end"),
        ),
        "placed",
    )
    live = placed.where("size > 0 AND target > 0")
    rounds = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("round")
    copies = live.select("*", rounds).select("size", _order(F.col("round")).alias("place"))
    last = _last(copies, budget)
    if last is None:
        taken = F.lit(0)
    else:
        cut = F.struct(*[F.lit(last[n]).cast(t).alias(n) for n, t in
                         (("finish", "double"), ("key", "string"), ("source", "string"), ("round", "int"))])
        taken = sum((F.when(_order(n) <= cut, 1).otherwise(0) for n in range(1, repeats + 1)), F.lit(0))
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0)
    return placed.select(
        "doc_id", "source", "key", "size", "source_size", "target", "queue_end", taken.cast("int").alias("copies"),
        (taken * F.col("size")).cast("long").alias("taken"),
    )


def drawn(docs: DataFrame, mixed: DataFrame, seed: str = "") -> DataFrame:
    """(finish, round, doc): every copy of the mix with the row of ``docs`` as a struct.

    Sort by (finish, round) to read the mix in its order. Rows that agree in doc_id, text and source
    stand for each other.
    """
    names = ["doc_id", "key", "source"]
    rows = docs.select("doc_id", "source", key_of(seed).alias("key"), F.struct(*docs.columns).alias("doc"))
    rows = rows.dropDuplicates(names).select(*[F.col(n).alias(f"_{n}") for n in names], "doc")
    copies = mixed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("round"))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return copies.select(*names, _finish(F.col("round")).alias("finish"), "round").join(rows, same).select("finish", "round", "doc")
