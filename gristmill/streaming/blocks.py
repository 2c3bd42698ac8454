"""Blocks with an expiry, on a stream: value state and event-time timers of transformWithState.

A key whose calls reach a threshold in a trailing window is blocked for a while. Calls in that time are
rejected and not counted; the block ends at its time, by the next call or by a timer that the watermark
sets off, and the number of blocks of a key stays. State: at most `threshold` times, an end and a number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(spark: SparkSession) -> None:
    """Timers need a state store of this kind; a session that names one keeps its own."""
    if spark.conf.get(_PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


class _Blocks(StatefulProcessor):
    def __init__(self, threshold: int, window_ms: int, block_ms: int, kind: str) -> None:
        self.threshold, self.window, self.block, self.kind = threshold, window_ms, block_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "t array<bigint>")
        self.held = handle.getValueState("held", "until bigint, n bigint")

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        event, at, outcome, n = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
        return pd.DataFrame({"key": pd.Series([key] * len(rows), dtype=self.kind), "event": pd.Series(event, dtype="Int64"), "ms": pd.Series(at, dtype="int64"), "outcome": pd.Series(outcome, dtype=object), "n_blocks": pd.Series(n, dtype="int64")})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["ms", "event"], kind="stable")
        times = list(self.times.get()[0]) if self.times.exists() else []
        until, n = self.held.get() if self.held.exists() else (None, 0)
        before, out = until, []
        for event, at in zip(calls["event"].tolist(), calls["ms"].tolist(), strict=True):
            if until is not None and at >= until:
                out.append((None, until, "expired", n))
                until = None
            if until is not None:
                out.append((event, at, "rejected", n))
                continue
            times = [*[t for t in times if t > at - self.window], at][-self.threshold :]
            if len(times) >= self.threshold:
                until, n = at + self.block, n + 1
            out.append((event, at, "counted" if until is None else "block", n))
        self.times.update((times,))
        self.held.update((until, n))
        if before != until:
            if before is not None:
                self.handle.deleteTimer(before)
            if until is not None:
                self.handle.registerTimer(until)
        yield self._frame(key[0], out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until, n = self.held.get() if self.held.exists() else (None, 0)
        if until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.update((None, n))
            yield self._frame(key[0], [(None, until, "expired", n)])
        else:
            yield self._frame(key[0], [])

    def close(self) -> None:
        pass


def stream_blocks(stream: DataFrame, key: str, ts: str, event: str, threshold: int, window_s: int, block_s: int, late: str = "0 seconds") -> DataFrame:
    """(key, event, ms, outcome, n_blocks): counted, block, rejected or expired (event null). Keys are integers and not null."""
    with_rocks(stream.sparkSession)
    when = F.col(ts).cast("timestamp")
    rows = stream.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(event).cast("bigint").alias("event"), when.alias("ts"), F.unix_millis(when).alias("ms"))
    calls = _Blocks(threshold, window_s * 1000, block_s * 1000, "int64")
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(calls, "key bigint, event bigint, ms bigint, outcome string, n_blocks bigint", "append", "eventtime")
