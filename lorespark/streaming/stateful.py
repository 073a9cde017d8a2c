"""State with timers: token buckets, heartbeats that time out, running counts of sessions.

Each operator keeps a few numbers for a key in the state store and takes a key's rows in the
order of their time, batch after batch.  What depends on nothing happening is done by event-time
timers, so it comes when the watermark passes, whether or not the key has further rows.
Rows of one key are taken one after the other; rows that come later than the watermark allows are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_US = 3_600_000_000


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["us", "event_id"])


class Bucket(StatefulProcessor):
    """A bucket of tokens, one more every ``every_us``; an event takes one, or is refused.  A token counts as that many units, so that refills are whole numbers."""

    def __init__(self, capacity: int, every_us: int):
        self.capacity, self.every_us = capacity * every_us, every_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", _longs("units", "last"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows)
        units, last = self.state.get() if self.state.exists() else (self.capacity, None)
        allowed = []
        for us in frame["us"].tolist():
            if last is not None:
                units = min(self.capacity, units + max(0, us - last))
            last = us if last is None else max(last, us)
            allowed.append(units >= self.every_us)
            units -= self.every_us * allowed[-1]
        self.state.update((units, last))
        yield pd.DataFrame({"user_id": key[0], "event_id": frame["event_id"].to_numpy(), "allowed": allowed})

    def close(self) -> None:
        pass


class Heartbeats(StatefulProcessor):
    """Who was last heard of when, and a row each time a silence lasts for ``gap_us``."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", _longs("last", "beats"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, beats = self.state.get() if self.state.exists() else (None, 0)
        silent = []
        for us in _ordered(rows)["us"].tolist():
            if last is not None and us - last >= self.gap_us:  # the silence ended within one batch, before its timer
                silent.append((last, beats))
                beats = 0
            last, beats = us if last is None else max(last, us), beats + 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(last + self.gap_us) // 1000))
        self.state.update((last, beats))
        if silent:
            yield self._rows(key, silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, beats = self.state.get()
        self.state.clear()
        yield self._rows(key, [(last, beats)])

    def _rows(self, key, silent: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": key[0], "last_us": [s[0] for s in silent], "beats": [s[1] for s in silent]})

    def close(self) -> None:
        pass


class Running(StatefulProcessor):
    """Counts of a key so far, and which of them are over a value: a row for each batch that the key has rows in."""

    def __init__(self, least: float):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counts", _longs("n", "n_over"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, over = self.state.get() if self.state.exists() else (0, 0)
        for frame in rows:
            n, over = n + len(frame), over + int((frame["value"] > self.least).sum())
        self.state.update((n, over))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "n_over": [over]})

    def close(self) -> None:
        pass


def _keyed(events: DataFrame) -> DataFrame:
    ship(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.where("user_id is not null and ts is not null").select("user_id", "event_id", "ts", "value", F.unix_micros("ts").alias("us"))


def token_bucket(events: DataFrame, capacity: int = 5, every_us: int = HOUR_US) -> DataFrame:
    """(user_id, event_id, allowed) of each event with a user and a time."""
    return _keyed(events).groupBy("user_id").transformWithStateInPandas(Bucket(capacity, every_us), "user_id long, event_id long, allowed boolean", "append", "none")


def silences(events: DataFrame, gap_us: int = 12 * HOUR_US, late: str = "1 hour") -> DataFrame:
    """(user_id, last_us, beats): each silence of ``gap_us`` or more, when it began, and how many events came before it since the last one."""
    return _keyed(events).withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Heartbeats(gap_us), "user_id long, last_us long, beats long", "append", "eventTime")


def running_counts(events: DataFrame, least: float = 50.0) -> DataFrame:
    """(user_id, n, n_over): each user's events so far and those over ``least``, with every batch that has some."""
    return _keyed(events).groupBy("user_id").transformWithStateInPandas(Running(least), "user_id long, n long, n_over long", "update", "none")
