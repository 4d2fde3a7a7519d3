"""Access-log reports as Structured Streaming jobs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from habitus.operators.access import (
    AUDIT_SCHEMA,
    LIMIT,
    WINDOW_SECONDS,
    AdmissionLog,
    audit_pairs,
    epoch_micros,
    lookups,
    merge_pairs,
    micros_to_ts,
    nullable,
)
from habitus.sources import generations

#: Batches of audit pairs that lie in folders of their own.
MERGE_EVERY = 8

#: Seconds by which requests may come late, behind the newest one of any client.
LATENESS_SECONDS = 3600


def stream_audit(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Lookups from a folder that audit files keep arriving in."""
    files = spark.readStream.schema(AUDIT_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return lookups(files.json(path))


def write_audit_pairs(
    accesses: DataFrame, folder: str, checkpoint: str, merge_every: int = MERGE_EVERY
) -> DataStreamWriter:
    """Write the pairs of each batch under its own number, and merge the batches now and then.

    The batch transform is the one the batch report uses. Nothing is kept between batches, and a
    repeated batch overwrites its own folder, or is passed over if it is merged already. After every
    ``merge_every`` batches they are added to the generation before (0: never).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= _merged_until(spark, folder):
            return
        audit_pairs(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if merge_every and (number + 1) % merge_every == 0:
            merge_audit_pairs(spark, folder, number)

    return accesses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _merged_until(spark: SparkSession, folder: str) -> int:
    """Number of the last batch that is part of a generation, -1 without one."""
    return int(generations.latest(spark, folder) or -1)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.removeprefix("batch=")) for n in generations.names(spark, f"{folder}/batch=*"))


def merge_audit_pairs(spark: SparkSession, folder: str, until: int) -> None:
    """Merge the batches up to ``until`` into one generation and remove their folders.

    A batch counts either by its folder or by the newest generation, whose name says up to which
    batch it goes; so a merge that is lost before or after its commit can be repeated.
    """
    if until > _merged_until(spark, folder):
        pairs = _pairs(spark, folder, until)
        generations.write(merge_pairs(pairs), folder, f"{until:012d}")
    for number in _batches(spark, folder):
        if number <= until:
            generations.remove(spark, f"{folder}/batch={number}")


def _pairs(spark: SparkSession, folder: str, until: int | None = None) -> DataFrame:
    """Rows of the newest generation and of the batches after it."""
    merged = _merged_until(spark, folder)
    numbers = [n for n in _batches(spark, folder) if n > merged and (until is None or n <= until)]
    fresh = [f"{folder}/batch={n}" for n in numbers]
    if merged < 0:
        return spark.read.parquet(*fresh) if fresh else spark.read.parquet(folder)
    whole = generations.read(spark, folder, f"{merged:012d}")
    return whole.unionByName(spark.read.schema(whole.schema).parquet(*fresh)) if fresh else whole


def read_audit_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All batches merged to one row per accessor and user."""
    return merge_pairs(_pairs(spark, folder))


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Requests per client and instant of each batch, ahead of the shuffle."""
    for batch in batches:
        yield batch.groupby(["client", "at"], as_index=False, dropna=False).agg(
            requests=("requests", "sum")
        )


def _decide_with_state(window: int, limit: int):
    """Decisions of one client in one micro-batch, continuing its admission log."""

    def run(
        key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # idle for so long that no entry counts any more
            state.remove()
            return
        held, counts, newest = state.get if state.exists else ([], [], None)
        log = AdmissionLog(window, limit, zip(held, counts))
        totals: Counter[int] = Counter()
        for batch in batches:
            for at, requests in zip(batch["at"].tolist(), batch["requests"].tolist()):
                totals[at] += requests
        instants = sorted(totals)
        late = [s for s in instants if newest is not None and s < newest]
        due = instants[len(late) :]
        admitted, waits = log.decide(due, [totals[s] for s in due])
        newest = due[-1] if due else newest
        state.update(
            (
                [at for at, _ in log.entries],
                [count for _, count in log.entries],
                newest,
            )
        )
        idle = newest // 1000 + 1000 * window + 1
        state.setTimeoutTimestamp(max(idle, state.getCurrentWatermarkMs() + 1))
        requests = [totals[s] for s in instants]
        yield pd.DataFrame(
            {
                "client": key[0],
                "at": instants,
                "requests": requests,
                "admitted": [0] * len(late) + admitted,
                "retry_after": nullable([0] * len(late) + waits),
                "late": requests[: len(late)] + [0] * len(due),
            }
        )

    return run


def throttle_stream(
    requests: DataFrame,
    limit: int = LIMIT,
    window: int = WINDOW_SECONDS,
    lateness: int = LATENESS_SECONDS,
) -> DataFrame:
    """Decisions per client and instant, as requests arrive.

    The state of a client is at most ``limit`` admission times, and is dropped when the
    watermark, ``lateness`` seconds behind the newest request of any client, is a window
    past its own newest one: nothing counts by then. Requests older than the newest
    instant already decided for their client cannot be decided in order any more: they
    are neither let in nor refused but counted in ``late``. Requests older than the
    watermark are dropped by the engine.
    """
    if limit <= 0:
        raise ValueError("a stream without a limit needs no decisions")
    partial = requests.select(
        F.coalesce("client", F.lit("unknown")).alias("client"),
        epoch_micros(F.col("ts")).alias("at"),
        F.lit(1).cast("long").alias("requests"),
    ).mapInPandas(_combine, "client string, at long, requests long")
    timed = partial.withColumn("event_time", F.timestamp_micros("at")).withWatermark(
        "event_time", f"{lateness} seconds"
    )
    decided = timed.groupBy("client").applyInPandasWithState(
        _decide_with_state(window, limit),
        "client string, at long, requests long, admitted long, retry_after long, late long",
        "instants array<long>, counts array<long>, newest long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return decided.select(
        "client",
        micros_to_ts(F.col("at")).alias("ts"),
        "requests",
        "admitted",
        (F.col("requests") - F.col("admitted") - F.col("late")).alias("refused"),
        "retry_after",
        "late",
    )
