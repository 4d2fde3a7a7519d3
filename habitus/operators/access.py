"""Reports over access logs: who looked up whom, and which requests a limit refuses.

Limits are decided on the microseconds of the requests; only the wait told to a refused
client is in whole seconds. Requests of one client at the same instant are combined.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from habitus.functions.clients import accessor
from habitus.session import cut_lineage
from habitus.sources.tables import guard_missing

# The audit line and the event name of a lookup.
AUDIT_SCHEMA = (
    "event string, timestamp string, client string, analyst string, user_id string, found boolean"
)
LOOKUP_EVENT = "user_timeline_access"

# The default limit.
LIMIT = 120
WINDOW_SECONDS = 60

_SHORTEST_BUCKET = 3600
_SECOND = 1_000_000


# ---------------------------------------------------------------- audit report


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit lines (JSON) of user lookups, with ``ts`` as an instant."""
    with guard_missing(path, "collect the audit log there"):
        lines = spark.read.schema(AUDIT_SCHEMA).json(path)
    return lookups(lines)


def lookups(lines: DataFrame) -> DataFrame:
    return (
        lines.where(F.col("event") == LOOKUP_EVENT)
        .withColumn("ts", F.to_timestamp("timestamp"))
        .drop("event", "timestamp")
    )


def audit_pairs(accesses: DataFrame) -> DataFrame:
    """Per accessor and looked-up user: lookups, misses, first and last time.

    These partial results merge (see ``merge_pairs``), so a stream can write one set
    per batch and needs no state.
    """
    return (
        accesses.withColumn("accessor", accessor(F.col("analyst"), F.col("client")))
        .groupBy("accessor", "user_id")
        .agg(
            F.count(F.lit(1)).alias("lookups"),
            F.count_if(~F.col("found")).alias("not_found"),
            F.min("ts").alias("first_access"),
            F.max("ts").alias("last_access"),
        )
    )


def merge_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("accessor", "user_id").agg(
        F.sum("lookups").alias("lookups"),
        F.sum("not_found").alias("not_found"),
        F.min("first_access").alias("first_access"),
        F.max("last_access").alias("last_access"),
    )


def audit_report(pairs: DataFrame) -> DataFrame:
    """Per accessor: lookups, distinct users, share not found, first and last time.

    Works on pairs, so distinct users are counted without a distinct aggregation and
    an accessor with many lookups is already split by looked-up user.
    """
    lookups_total = F.sum("lookups")
    return pairs.groupBy("accessor").agg(
        lookups_total.alias("lookups"),
        F.count("user_id").alias("distinct_users"),
        (F.sum("not_found") / lookups_total).alias("not_found_share"),
        F.min("first_access").alias("first_access"),
        F.max("last_access").alias("last_access"),
    )


# ------------------------------------------------------------- request limits


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, independent of the session zone."""
    days = F.unix_date(F.to_date(ts)).cast("long")
    whole = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole * _SECOND + (F.date_part(F.lit("second"), ts) * _SECOND).cast("long")


def micros_to_ts(micros: Column) -> Column:
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=(micros.cast("decimal(24,6)") / _SECOND).cast("decimal(18,6)"))


def requests_per_instant(requests: DataFrame) -> DataFrame:
    """``client, at, requests``, combined on the map side; ``at`` in microseconds."""
    return (
        requests.select(
            F.coalesce("client", F.lit("unknown")).alias("client"),
            epoch_micros(F.col("ts")).alias("at"),
        )
        .groupBy("client", "at")
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def _bucket_span(window: int) -> int:
    return max(window, _SHORTEST_BUCKET) * _SECOND


def trailing_requests(instants: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """Add ``trailing``: requests of the client in the last ``window`` seconds, inclusive.

    A client's time line is cut into buckets no shorter than the window. Each bucket
    also gets the instants of the bucket before that its first rows can still see, so
    every (client, bucket) is computed on its own: one client with a third of the log
    is spread over as many tasks as others.
    """
    span, reach = _bucket_span(window), window * _SECOND
    bucket = F.floor(F.col("at") / span).cast("long")
    own = instants.withColumn("bucket", bucket).withColumn("copy", F.lit(False))
    carried = (
        instants.withColumn("bucket", bucket + 1)
        .where(F.col("at") >= F.col("bucket") * span - reach)
        .withColumn("copy", F.lit(True))
    )
    last = Window.partitionBy("client", "bucket").orderBy("at").rangeBetween(-reach, 0)
    return (
        own.unionByName(carried)
        .withColumn("trailing", F.sum("requests").over(last))
        .where(~F.col("copy"))
        .drop("copy")
    )


def trailing_request_count(requests: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """``client, ts, requests, trailing`` per client and instant."""
    counted = trailing_requests(requests_per_instant(requests), window)
    return counted.select("client", micros_to_ts(F.col("at")).alias("ts"), "requests", "trailing")


class AdmissionLog:
    """Requests of one client that were let in and still count.

    Times are in microseconds, the window in seconds. An entry counts until it is
    strictly older than the window; a refused request is not recorded. The limit is at
    least 1.
    """

    def __init__(self, window: int, limit: int, entries: Iterable[tuple[int, int]] = ()):
        self.reach, self.limit = window * _SECOND, limit
        self.entries = deque(entries)
        self.used = sum(count for _, count in self.entries)

    def decide(
        self, instants: Sequence[int], requests: Sequence[int]
    ) -> tuple[list[int], list[int]]:
        """For instants in order: number let in, and seconds the refused ones have to wait.

        The wait is 0 where none is refused.
        """
        entries, reach, limit, used = self.entries, self.reach, self.limit, self.used
        admitted, waits = [], []
        for at, wanted in zip(instants, requests):
            while entries and entries[0][0] < at - reach:
                used -= entries.popleft()[1]
            taken = min(wanted, max(0, limit - used))
            if taken:
                entries.append((at, taken))
                used += taken
            admitted.append(taken)
            left = 0 if taken == wanted else entries[0][0] + reach - at
            waits.append(0 if taken == wanted else left // _SECOND + 1)
        self.used = used
        return admitted, waits


def nullable(waits: Sequence[int]) -> pd.api.extensions.ExtensionArray:
    """Waiting times with NULL for 0."""
    values = np.array(waits, dtype=np.int64)
    return pd.arrays.IntegerArray(values, values == 0)


def _decide_sorted(window: int, limit: int):
    """Decisions over rows sorted by (client, stretch, at), batch by batch.

    Memory is one batch plus the entries of the client at hand.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, AdmissionLog(window, limit)
        for batch in batches:
            client, stretch = batch["client"].to_numpy(), batch["stretch"].to_numpy()
            changes = (client[1:] != client[:-1]) | (stretch[1:] != stretch[:-1])
            bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), len(batch)]
            instants, requests = batch["at"].tolist(), batch["requests"].tolist()
            admitted, waits = [], []
            for start, end in zip(bounds, bounds[1:]):
                if current != (client[start], stretch[start]):
                    current = (client[start], stretch[start])
                    log = AdmissionLog(window, limit)
                taken, wait = log.decide(instants[start:end], requests[start:end])
                admitted += taken
                waits += wait
            yield batch[["client", "at", "requests"]].assign(
                admitted=np.array(admitted, dtype=np.int64), retry_after=nullable(waits)
            )

    return run


def stretches(counted: DataFrame, window: int, limit: int) -> DataFrame:
    """``client, first, last`` of each run of instants over the limit.

    A stretch ends where the next crowded instant is more than a window away: by then
    every request that still counts came in at an uncrowded instant and was let in.
    Runs are found within each bucket first; the line of one client then has a row for
    each of those only.
    """
    reach = window * _SECOND

    def runs(rows: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
        line = Window.partitionBy(*keys).orderBy(first)
        gap = F.col(first) - F.lag(last).over(line)
        begins = F.when(gap.isNull() | (gap > reach), F.col(first))
        return (
            rows.withColumn("_begins", begins)
            .withColumn("_run", F.last("_begins", ignorenulls=True).over(line))
            .groupBy(*keys, "_run")
            .agg(F.min(first).alias("first"), F.max(last).alias("last"))
            .drop("_run")
        )

    crowded = counted.where(F.col("trailing") > limit).select("client", "bucket", "at")
    inside = runs(crowded, ["client", "bucket"], "at", "at").drop("bucket")
    return runs(inside, ["client"], "first", "last")


def throttle_decisions(
    requests: DataFrame, limit: int = LIMIT, window: int = WINDOW_SECONDS
) -> DataFrame:
    """Per client and instant: requests, let in, refused, seconds to wait.

    The limit is a sliding log of admitted requests, so decisions depend on earlier
    ones. Three facts keep the sequential part small and exact:

    * where all requests of the last window are within the limit, all are let in, and
      no history is needed to know it (a plain window sum);
    * crowded stretches of one client that lie more than a window apart do not
      influence each other, so each is decided on its own, beginning a window before
      its first crowded instant;
    * inside a stretch rows arrive sorted and are streamed, so the memory of a task
      does not grow with the stretch.

    Stretches are dealt to the buckets they touch, and one left join marks the rows of
    each. A limit of zero or less lets everything in.
    """
    instants = requests_per_instant(requests)
    if limit <= 0:
        return _decisions(_all_admitted(instants))
    counted = cut_lineage(trailing_requests(instants, window))
    span, reach = _bucket_span(window), window * _SECOND
    begin = F.col("first") - reach
    dealt = stretches(counted, window, limit).select(
        "client",
        begin.alias("begin"),
        "last",
        F.explode(
            F.sequence(F.floor(begin / span).cast("long"), F.floor(F.col("last") / span).cast("long"))
        ).alias("bucket"),
    )
    inside = F.col("at").between(F.col("begin"), F.col("last"))
    marked = cut_lineage(
        counted.alias("c")
        .join(
            dealt.alias("d"),
            (F.col("c.client") == F.col("d.client")) & (F.col("c.bucket") == F.col("d.bucket")) & inside,
            "left",
        )
        .select("c.client", F.col("begin").alias("stretch"), "at", "requests")
    )
    busy = (
        marked.where("stretch IS NOT NULL")
        .repartition("client", "stretch")
        .sortWithinPartitions("client", "stretch", "at")
    )
    decided = busy.mapInPandas(
        _decide_sorted(window, limit),
        "client string, at long, requests long, admitted long, retry_after long",
    )
    calm = _all_admitted(marked.where("stretch IS NULL"))
    return _decisions(calm.unionByName(decided))


def _all_admitted(instants: DataFrame) -> DataFrame:
    return instants.select(
        "client",
        "at",
        "requests",
        F.col("requests").alias("admitted"),
        F.lit(None).cast("long").alias("retry_after"),
    )


def _decisions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "client",
        micros_to_ts(F.col("at")).alias("ts"),
        "requests",
        "admitted",
        (F.col("requests") - F.col("admitted")).alias("refused"),
        "retry_after",
    )
