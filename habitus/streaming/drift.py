"""Drift across runs: each actor's last days are kept as state, so new days need no history."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from habitus.config import DEFAULTS, Settings

#: Stream state of a processor of its own needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Actors are dealt by hash to so many groups, a row of state each. The number is part of the state:
#: a stream goes on with the one it was started with.
GROUPS = 1024
GROUP = "actor_group"


@contextmanager
def list_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that processors need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def last_days(days: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The days of each actor that the next one's trailing mean looks back on: one less than the window."""
    newest = Window.partitionBy(settings.actor).orderBy(F.desc(settings.day))
    ranked = days.where(F.col(settings.actor).isNotNull()).withColumn("_age", F.row_number().over(newest))
    return ranked.where(F.col("_age") < settings.drift_window).select(
        settings.actor, settings.day, *settings.features
    )


class TrailingDays(StatefulProcessor):
    """Adds to every day the sum and count of each feature over its actor's trailing rows.

    A key is a group of actors, so that a call and a look-up of state serve many of them. The state is
    the group's last days as one row of columns, in order of actor and day: at most one day less
    than the window per actor. A day that is not later than the newest one kept of its actor comes too
    late to be put in order; it is marked and neither kept nor given sums.
    """

    def __init__(self, settings: Settings, actor_type: T.DataType):
        self.settings, self.actor_type = settings, actor_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("actors", T.ArrayType(self.actor_type))]
        fields += [T.StructField("days", T.ArrayType(T.IntegerType()))]
        fields += [T.StructField(f, T.ArrayType(T.LongType())) for f in self.settings.features]
        self.days = handle.getValueState("days", T.StructType(fields))

    def _held(self) -> pd.DataFrame:
        kept = self.days.get() if self.days.exists() else [[] for _ in range(2 + len(self.settings.features))]
        names = [self.settings.actor, "_day", *self.settings.features]
        kinds = [object, float, *["Int64"] * len(self.settings.features)]
        return pd.DataFrame({n: pd.Series(list(v), dtype=k) for n, v, k in zip(names, kept, kinds, strict=True)})

    def _dealt(self, frame: pd.DataFrame) -> pd.DataFrame:
        """The columns of ``_held`` of arrived rows."""
        found = {self.settings.actor: frame[self.settings.actor].astype(object)}
        found["_day"] = _numbers(frame[self.settings.day]).astype(float)
        return pd.DataFrame(found | {f: frame[f].astype("Int64") for f in self.settings.features})

    def _keep(self, ordered: pd.DataFrame, first: np.ndarray) -> None:
        """The newest days of each actor; ``first``: the place where the actor of a row begins."""
        days = ordered["_day"].to_numpy()
        # A row without a day is the last of its actor, and the next ones have nothing to be ordered by.
        dated = ~np.isnan(days)
        behind = first + np.bincount(first, weights=dated, minlength=len(days)).astype(int)[first]
        newest = ordered[dated & (np.arange(len(days)) > behind - max(2, self.settings.drift_window))]
        columns = [newest[self.settings.actor].tolist(), newest["_day"].astype(int).tolist()]
        columns += [newest[f].astype(object).where(newest[f].notna(), None).tolist() for f in self.settings.features]
        self.days.update(tuple(columns))

    def _ordered(self, frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """Rows by actor and day, and for each the place where its actor begins."""
        codes = pd.factorize(frame[self.settings.actor])[0]
        order = np.lexsort((frame["_day"].to_numpy(), codes))
        begins = np.flatnonzero(np.diff(codes[order], prepend=-1))
        return frame.iloc[order], np.repeat(begins, np.diff(begins, append=len(frame)))

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timer: Any) -> None:  # noqa: N802
        """Rows of a group may come in several frames."""
        held, more = self._held(), self._dealt(initial)
        self._keep(*self._ordered(pd.concat([held, more], ignore_index=True) if len(held) else more))

    def handleInputRows(  # noqa: N802
        self, key: tuple, rows: Iterator[pd.DataFrame], timer: Any
    ) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        held, arrived = self._held(), self._dealt(frame)
        newest = held.groupby(self.settings.actor)["_day"].max()
        late = arrived["_day"] <= arrived[self.settings.actor].map(newest).astype(float)
        due = arrived[~late]
        both = pd.concat([held.set_index(pd.Index([-1] * len(held))), due]) if len(held) else due
        ordered, first = self._ordered(both)
        fresh = ordered.index.to_numpy() >= 0
        end = np.flatnonzero(fresh) + 1
        low = np.maximum(end - self.settings.drift_window, first[fresh])
        found = frame.drop(columns=GROUP).assign(late=late)
        for feature in self.settings.features:
            known = ordered[feature].notna().to_numpy()
            values = ordered[feature].to_numpy(dtype="int64", na_value=0)
            for kind, numbers in (("sum", values), ("rows", known.astype("int64"))):
                running = np.concatenate([[0], np.cumsum(numbers)])
                trailing = pd.Series(running[end] - running[low], ordered.index[fresh], "Int64")
                found[f"_{kind}_{feature}"] = trailing.reindex(found.index)
        if len(due):
            self._keep(ordered, first)
        yield found

    def close(self) -> None:
        pass


def _numbers(days: pd.Series) -> pd.Series:
    """Days since 1970."""
    return (pd.to_datetime(days) - pd.Timestamp(0)).dt.days


def recent_means_stream(
    days: DataFrame,
    history: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    groups: int = GROUPS,
) -> DataFrame:
    """A stream of days with ``recent_*``, as ``recent_means`` gives them, and ``late``.

    ``history``: the rows of ``last_days``, with which the state begins. Days may come in any order
    within a batch. The features are integers; other columns are carried along. A late day has no
    trailing means. A batch of one group's days is handled at once: ``groups`` grows with the
    actors times the days of a batch.
    """
    added = [T.StructField("late", T.BooleanType())]
    for feature in settings.features:
        added += [T.StructField(f"_sum_{feature}", T.LongType()), T.StructField(f"_rows_{feature}", T.LongType())]
    group = F.pmod(F.xxhash64(settings.actor), F.lit(groups))
    start = history.withColumn(GROUP, group).groupBy(GROUP) if history is not None else None
    known = days.where(F.col(settings.actor).isNotNull()).withColumn(GROUP, group)
    found = known.groupBy(GROUP).transformWithStateInPandas(
        TrailingDays(settings, days.schema[settings.actor].dataType),
        T.StructType([*days.schema.fields, *added]), "Append", "None", start,
    )
    size = float(settings.drift_window)
    recent = {
        f"recent_{f}": F.when(
            F.col(f"_rows_{f}") >= settings.drift_window, F.col(f"_sum_{f}").cast("double") / F.lit(size)
        )
        for f in settings.features
    }
    helpers = [f"_{kind}_{f}" for f in settings.features for kind in ("sum", "rows")]
    return found.withColumns(recent).drop(*helpers)
