"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.llm.store import store


def _mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    row = links.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("high", "low")).alias("x"),
    ).collect()[0]
    return row["n"], row["x"]


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the smallest node reachable.

    Large-star and small-star rounds until nothing changes: each node's higher neighbours, then
    its lower ones, are linked to the smallest. A node with very many neighbours is only ever
    pre-aggregated and joined, never gathered. Each round is written to the shared folder.
    Loops, repeated links and nulls are ignored; no links give no rows.
    """
    now = store(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct(),
        name,
    )
    before, mark = None, _mark(now)
    while mark[0] and mark != before:
        around = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            now.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        # Stored, so that the join below has plain inputs: only those are split where skewed.
        least = store(least.select("u", F.least("u", "m").alias("m")), name)
        large = (
            around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = store(large, name)
        low = store(large.groupBy("u").agg(F.min("v").alias("m")), name)
        joined = large.join(low, "u")
        rounds = (
            joined.where("v <> m").select(F.col("v").alias("high"), F.col("m").alias("low"))
            .unionByName(low.select(F.col("u").alias("high"), F.col("m").alias("low")))
            .distinct()
        )
        now = store(rounds, name)
        before, mark = mark, _mark(now)
    roots = now.select(F.col("low").alias("node")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
