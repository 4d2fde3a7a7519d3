"""URL filters by a temporal list join.

List entries are dated events: a list adds or removes a value at a time. For each list and value
they become validity intervals, closed at the time of the add and open at the next removal. A
capture (a URL fetched at a time) is matched by its host, each parent domain and its whole URL
against the entries that were active when it was fetched: an as-of join.

The join is an equi-join on (scope, value, period), where intervals are dealt to the periods of
``PERIOD_DAYS`` days that they overlap; so a value with a long history does not meet every capture
of it. Entries are small beside captures and are pre-aggregated to intervals; a host with a third
of all captures is split by the planner's skew join, as each of its captures has its own row.

Native: column expressions and joins only.

Cases: a null URL or fetch time matches nothing; entries with a null list, scope, value, time or
action are no entries; repeated and simultaneous events of one value count once, a removal before
an add of the same time; a removal without an add is ignored; captures are rows, repeated ones
are judged one by one; empty tables give no matches; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 32
_DAY = 86_400


def host_of(url: Column) -> Column:
    """The lower-case host, without user, port and closing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, scope, value, since, until) from entries (list, scope, value, at, action).

    ``at``: a timestamp; ``action``: add or remove; ``until`` is null where the value still holds.
    """
    known = entries.select("list", "scope", F.lower("value").alias("value"), "at", "action").dropna()
    moments = known.groupBy("list", "scope", "value", "at").agg(
        F.max(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on")
    )
    order = Window.partitionBy("list", "scope", "value").orderBy("at")
    changes = moments.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(0))).where("on <> was")
    spans = changes.withColumn("until", F.lead("at").over(order)).where("on = 1")
    return spans.select("list", "scope", "value", F.col("at").alias("since"), "until")


def _period(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / (PERIOD_DAYS * _DAY))


def _keys(captures: DataFrame) -> DataFrame:
    """(page_id, at, period, scope, value): what an entry may name of each capture."""
    host = host_of(F.col("url"))
    parts = F.split("host", "\\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    url = F.array(F.struct(F.lit("url").alias("scope"), F.lower(F.trim("url")).alias("value")))
    hosts = F.concat(
        F.array(F.struct(F.lit("host").alias("scope"), F.col("host").alias("value"))),
        F.transform(parents, lambda p: F.struct(F.lit("domain").alias("scope"), p.alias("value"))),
    )
    named = F.when(F.col("host").isNull(), url).otherwise(F.concat(hosts, url))
    rows = captures.select("page_id", "url", "at", host.alias("host")).where("url IS NOT NULL AND at IS NOT NULL")
    return rows.distinct().select("page_id", "url", "at", _period(F.col("at")).alias("period"), F.inline(named))


def matches(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, at, list, scope, value, since) for every entry active at each fetch.

    ``captures``: page_id, url, at.
    """
    spans = intervals(entries)
    last = F.lit(captures.agg(F.max("at")).collect()[0][0]).cast("timestamp")
    spans = spans.where(F.col("since") <= last)
    end = F.least(last, F.coalesce("until", last))
    dealt = spans.select(
        "list", "scope", "value", "since", "until",
        F.explode(F.sequence(_period(F.col("since")), _period(end))).alias("period"),
    )
    active = (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    return (
        _keys(captures).join(dealt, ["scope", "value", "period"]).where(active)
        .select("page_id", "url", "at", "list", "scope", "value", "since")
    )


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, at, entries, lists, since, verdict) for each capture.

    ``allow`` if any list whose name begins with "allow" names it, else ``block`` if any other
    does, else ``pass``. ``since``: when the oldest of the active entries was added. Captures that
    agree in page_id, url and time are judged once and returned as often as they stand in the table.
    A URL without a host is met by entries for that URL only.
    """
    rows = captures.select("page_id", "url", "at")
    found = matches(captures, entries).select("page_id", "url", "at", "list", "scope", "value", "since")
    marked = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("list", "scope", "value")])
    marked = marked.withColumn("since", F.lit(None).cast(captures.schema["at"].dataType))
    marked = marked.withColumn("_copies", F.lit(1))
    found = found.withColumn("_copies", F.lit(0))
    each = marked.unionByName(found).groupBy("page_id", "url", "at").agg(
        F.sum("_copies").cast("int").alias("_copies"),
        F.count_distinct("list", "scope", "value").alias("entries"),
        F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
        F.min("since").alias("since"),
        F.coalesce(F.bool_or(F.startswith("list", F.lit("allow"))), F.lit(False)).alias("allowed"),
    )
    verdict = F.when(F.col("allowed"), "allow").when(F.col("entries") > 0, "block").otherwise("pass")
    each = each.withColumn("verdict", verdict).drop("allowed")
    again = F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")
    return each.select("*", again).drop("_copy", "_copies")
