"""Streams with timers: refreshes that wait for one another, jobs that fell silent, counts that are due at each tick.

Each is a state machine for one key. Rows of a batch are taken in order of their time and act as they would one by one; timers
of event time act for what follows the last row. State is what one key needs, and it goes when its timer has fired, so the store
holds the keys that are waiting, not all that were ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """Timers need a state store of columns."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _in_order(rows: Iterator[pd.DataFrame]) -> list[tuple]:
    """(time in ms, kind) of a batch's rows, by time, then kind."""
    return sorted((int(t), k) for part in rows for t, k in zip(part["ms"], part["kind"]))


class _Machine(StatefulProcessor):
    """State is one row of longs and strings; None: nothing is known of the key."""

    fields = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.fields)

    def _get(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def _put(self, state: tuple | None, due: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state is None:
            self.state.clear()
            return
        self.state.update(state)
        if due is not None:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class Refresh(_Machine):
    """Asked for (kind ask): refreshed at once unless one is pending, which lasts until it is done (kind done) or `wait` ms have passed."""

    fields = "until long"

    def __init__(self, wait: int):
        self.wait = wait

    def handleInputRows(self, key, rows, timerValues):
        state, out = self._get(), []
        until = state and state[0]
        for ms, kind in _in_order(rows):
            if kind == "done":
                until = None
            elif until is None or ms >= until:
                out.append(ms)
                until = ms + self.wait
        self._put(None if until is None else (until,), until)
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype="object"), "at": pd.Series(out, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._put(None, None)
        yield pd.DataFrame({"key": pd.Series([], dtype="object"), "at": pd.Series([], dtype="int64")})


class Silence(_Machine):
    """A job whose last status has a limit (ms) and that says nothing for longer has failed, at the time the limit was reached."""

    fields = "since long, status string"

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def _due(self, state: tuple | None) -> int | None:
        return state[0] + self.limits[state[1]] if state and state[1] in self.limits else None

    def handleInputRows(self, key, rows, timerValues):
        state, out = self._get(), []
        for ms, kind in _in_order(rows):
            due = self._due(state)
            if due is not None and ms > due:
                out.append((state[1], due))
            state = (ms, kind)
        due = self._due(state)
        self._put(state if due is not None else None, due)
        yield self._failed(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self._get()
        self._put(None, None)
        yield self._failed(key, [(state[1], self._due(state))] if state else [])

    @staticmethod
    def _failed(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype="object"), "status": pd.Series([s for s, _ in out], dtype="object"), "at": pd.Series([a for _, a in out], dtype="int64")})


class Ticks(_Machine):
    """How many rows came in each period (ms), told when it ends."""

    fields = "tick long, n long"

    def __init__(self, period: int):
        self.period = period

    def handleInputRows(self, key, rows, timerValues):
        state, out = self._get(), []
        for ms, _ in _in_order(rows):
            tick = ms - ms % self.period
            if state and tick > state[0]:
                out.append(state)
                state = None
            state = (state[0], state[1] + 1) if state else (tick, 1)
        self._put(state, state[0] + self.period)
        yield self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self._get()
        self._put(None, None)
        yield self._told(key, [state] if state else [])

    @staticmethod
    def _told(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype="object"), "at": pd.Series([t for t, _ in out], dtype="int64"), "n": pd.Series([n for _, n in out], dtype="int64")})


def _machine(rows: DataFrame, machine: _Machine, schema: str, late: str) -> DataFrame:
    """rows: key (string), ts (timestamp), kind. Rows of a key must not come later than those of a later time by more than `late`."""
    timed = rows.select("key", "ts", F.unix_millis("ts").alias("ms"), "kind").withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=machine, outputStructType=schema, outputMode="append", timeMode="eventTime")


def debounced(rows: DataFrame, wait: int, late: str = "0 seconds") -> DataFrame:
    """key, at (ms) of the refreshes that are made; see Refresh."""
    return _machine(rows, Refresh(wait), "key string, at long", late)


def fallen_silent(rows: DataFrame, limits: dict[str, int], late: str = "0 seconds") -> DataFrame:
    """key, status, at (ms) of the jobs that failed; see Silence."""
    return _machine(rows, Silence(limits), "key string, status string, at long", late)


def ticks(rows: DataFrame, period: int, late: str = "0 seconds") -> DataFrame:
    """key, at (ms), n of the periods that have ended; see Ticks."""
    return _machine(rows, Ticks(period), "key string, at long, n long", late)


def run_once(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append all there is to a Parquet target, exactly once over restarts."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
