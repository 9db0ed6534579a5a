"""A streaming twin of the pulse matcher, and windowed residuals.

Hits wait in list state, keyed by groups of boards, until an event-time timer tells that the watermark has
passed them; then they are taken in order, and leads without a trail wait on in a list of their
own. A pulse lasts at most ``high`` ticks, so a lead older than the watermark by more is dropped,
by a timer of its own if nothing else comes: state is bounded by the hits of one such span, and of
the allowed lateness, per board. The batch operator is the reference: up to the last watermark
both give the same pulses.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that list state and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Groups of boards that share a state; a call costs the same for one board and for many.
GROUPS = 512


class _Pulses(StatefulProcessor):
    """Hits (``board``, ``ticks`` in microseconds, ``kind``) of a group of boards to pulses; the group -1 is the null board."""

    def __init__(self, key: str, kind: str, low: int, high: int):
        self.key, self.kind, self.low, self.high = key, kind, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", f"board {self.kind}, t long, kind int")
        self.leads = handle.getListState("leads", f"board {self.kind}, t long")

    def _found(self, key, rows: list) -> pd.DataFrame:
        boards = [b if key[0] >= 0 else None for b, _, _ in rows]
        return pd.DataFrame({self.key: pd.Series(boards, dtype=object), "lead": [a for _, a, _ in rows], "trail": [t for _, _, t in rows]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first = None
        for b in rows:
            if len(b):
                self.hits.appendList(list(zip(b["board"].tolist(), b["ticks"].tolist(), b["kind"].tolist(), strict=True)))
                least = int(b["ticks"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first, timerValues)
        yield self._found(key, [])

    def _wake(self, t: int, timerValues) -> None:  # noqa: N803
        """A timer for when the watermark has passed ``t``, unless an earlier one is to come."""
        now = timerValues.getCurrentWatermarkInMs()
        at = max(-(-t // 1000), now + 1)
        if not any(now < x <= at for x in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(b, int(t), int(k)) for b, t, k in self.hits.get()] if self.hits.exists() else []
        ready, rest = sorted(x for x in held if x[1] <= limit), [x for x in held if x[1] > limit]
        waiting: dict = {}
        for b, t in sorted((b, int(t)) for b, t in self.leads.get()) if self.leads.exists() else []:
            waiting.setdefault(b, deque()).append(t)
        found = []
        for b, t, k in ready:
            own = waiting.setdefault(b, deque())
            if k == 0:
                own.append(t)
                continue
            while own and t - own[0] > self.high:
                own.popleft()
            if own and t - own[0] >= self.low:
                found.append((b, own.popleft(), t))
        leads = [(b, t) for b, own in waiting.items() for t in own if limit - t <= self.high]
        for state, kept in ((self.hits, rest), (self.leads, leads)):
            if kept:
                state.put(kept)
            else:
                state.clear()
        if rest:
            self._wake(min(t for _, t, _ in rest), timerValues)
        elif leads:
            self._wake(max(t for _, t in leads) + self.high + 1000, timerValues)
        yield self._found(key, found)

    def close(self) -> None:
        pass


def state_store(spark: SparkSession) -> None:
    """Sets the state store of streams that this session starts from now on."""
    spark.conf.set(*STORE)


def longest_valid_pulses(hits: DataFrame, key: str, event_time: str, ticks: str, kind: str, low: int, high: int, late: str = "10 minutes") -> DataFrame:
    """Pulses of a stream of hits: ``key``, ``lead``, ``trail`` in ticks.

    ``kind`` is 0 for a lead and 1 for a trail. Hits may come out of order by ``late``. Call
    ``state_store`` before the stream is started. Boards are numbers or strings.
    """
    types = dict(hits.dtypes)
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS))).cast("int")
    board = F.coalesce(F.col(key), F.lit("0").cast(types[key])).alias("board")
    rows = hits.withWatermark(event_time, late).select(group.alias("_group"), board, event_time, F.col(ticks).cast("long").alias("ticks"), F.col(kind).cast("int").alias("kind")).where("ticks is not null and kind is not null")
    return rows.groupBy("_group").transformWithStateInPandas(_Pulses(key, types[key], low, high), f"{key} {types[key]}, lead long, trail long", "Append", "EventTime")


def running_residuals(hits: DataFrame, event_time: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and moments per event-time window, final once the watermark has passed."""
    x = F.col(value)
    return hits.withWatermark(event_time, late).groupBy(F.window(event_time, window)).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
