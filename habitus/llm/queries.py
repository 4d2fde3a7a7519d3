"""The registered queries of this subpackage, each over its whole table, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.llm import (
    centroids,
    decontamination,
    htmltext,
    minhash,
    mixing,
    packing,
    paragraphs,
    pii,
    repair,
    simhash,
    spelling,
    toxicity,
    urlfilter,
)
from habitus.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The vocabulary file that the contracts name; it lies at the same place on every machine."""
    return str(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary())


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    chain = toxicity.train(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, chain)
    return scored.withColumns({c: F.round(c, 6) for c in scored.columns if c.startswith("p_")})


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


#: Seconds from the first derived fetch to the last, and when they begin.
_FETCHED_FROM, _FETCH_SPAN = 1_704_067_200, 360 * 86_400


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as captures: fetch times derived from page_id, spread over 360 days."""
    at = F.lit(_FETCHED_FROM) + F.pmod(F.col("page_id") * 7919, F.lit(_FETCH_SPAN))
    return table(spark, folder, "pages").select("page_id", "url", F.timestamp_seconds(at).alias("at"))


def list_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Dated entries of three lists, derived from the hosts and URLs of the pages.

    A third of the hosts is blocked from some day on, half of these for 90 days only; a quarter
    of the domains above hosts is blocked, freed 60 days later and blocked again after 60 more; a
    fiftieth of the URLs is allowed from some day on.
    """
    host = urlfilter.host_of(F.col("url"))
    rows = table(spark, folder, "pages").select(host.alias("host"), F.lower(F.trim("url")).alias("url"))

    def numbered(value, scope: str) -> DataFrame:
        digits = F.conv(F.substring(F.md5(F.col("value")), 1, 6), 16, 10).cast("long")
        found = rows.select(value.alias("value")).where("value IS NOT NULL").distinct()
        return found.select(F.lit(scope).alias("scope"), "value", digits.alias("k"))

    def event(name: str, days: int, action: str):
        at = F.lit(_FETCHED_FROM) + (F.pmod("k", F.lit(300)) + days) * 86_400
        return F.struct(F.lit(name).alias("list"), F.timestamp_seconds(at).alias("at"), F.lit(action).alias("action"))

    hosts = numbered(F.col("host"), "host").where("k % 3 = 0").select(
        "scope", "value",
        F.inline(F.when(F.col("k") % 2 == 0, F.array(event("block-hosts", 0, "add"), event("block-hosts", 90, "remove")))
                 .otherwise(F.array(event("block-hosts", 0, "add")))),
    )
    above = F.nullif(F.regexp_extract("host", r"^[^.]+\.(.+)$", 1), F.lit(""))
    domains = numbered(above, "domain").where("k % 4 = 0").select(
        "scope", "value",
        F.inline(F.array(*[event("block-domains", d, a) for d, a in ((0, "add"), (60, "remove"), (120, "add"))])),
    )
    urls = numbered(F.col("url"), "url").where("k % 50 = 0").select(
        "scope", "value", F.inline(F.array(event("allow-urls", 0, "add")))
    )
    return hosts.unionByName(domains).unionByName(urls)


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    judged = urlfilter.judged(captures(spark, folder), list_entries(spark, folder))
    seconds = lambda c: F.unix_seconds(c).alias(c)
    return judged.select("page_id", "url", seconds("at"), "entries", "lists", seconds("since"), "verdict")


def op5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.duplicates(table(spark, folder, "documents"), lines=1)


def op6_repair(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "repair-shards")
    repair.write(table(spark, folder, "documents"), vocabulary(), path)
    return repair.read(spark, path)


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), length=3, most=3)


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.overlaps(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.compared(table(spark, folder, "documents"))


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(table(spark, folder, "pages"))


def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.runs(table(spark, folder, "documents")))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.summed(*centroids.cluster(table(spark, folder, "embeddings")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_packing, op2_toxicity, op3_pii, op4_url_filters, op5_paragraphs, op6_repair, op7_simhash,
        op8_decontamination, op9_minhash, op10_main_text, op11_mixing, op12_spelling, op13_centroids,
    )
}
