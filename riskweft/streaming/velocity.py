"""Time-window operators on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from riskweft.session import ship

OUTPUT = "txn_id long, account_id long, ts timestamp, vel_count int, vel_amount double"

#: Fixed value: the state store that keeps single entries, which processors with timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Trailing(StatefulProcessor):
    """State of an account: the rows that one yet to come may look back on, as one entry under the number of its first
    bucket of time (as wide as the window). A batch costs an account one read, one write and a timer, however its rows are
    spread in time; rows that the watermark has put out of reach go as it writes, and the timer removes what is left once no
    row that may come can look back on it. Times and amounts are packed numbers."""

    def __init__(self, seconds: int):
        self.window = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket long", "micros binary, amounts binary")

    def _held(self) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(bucket numbers, times, amounts) of the entry, if there is one."""
        entries = list(self.buckets.iterator())
        times, amounts = (np.concatenate([np.zeros(0, k), *[np.frombuffer(bytes(v[i]), k) for _, v in entries]]) for i, k in ((0, np.int64), (1, np.float64)))
        return [k[0] for k, _ in entries], times, amounts

    def _end(self, times: np.ndarray) -> int:
        """The watermark in milliseconds at which nothing can look back on these rows any more."""
        return (int(times[-1]) + self.window) // 1000 + 1

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["ts", "txn_id"])
        now = rows["ts"].to_numpy("datetime64[us]").astype(np.int64)
        amounts = rows["amount"].fillna(0.0).to_numpy(float)
        names, seen, before = self._held()
        # rows of earlier batches are sorted by time, and so are these: all that is asked for lies between two places
        counts, sums = np.zeros(len(now), np.int64), np.zeros(len(now))
        for times, values, end in ((seen, before, np.searchsorted(seen, now, "right")), (now, amounts, np.arange(len(now)))):
            start = np.minimum(np.searchsorted(times, now - self.window, "right"), end)
            total = np.concatenate([[0.0], np.cumsum(values)])
            counts += end - start
            sums += total[end] - total[start]
        times, values = np.concatenate([seen, now]), np.concatenate([before, amounts])
        order = np.argsort(times, kind="stable")
        order = order[times[order] > timerValues.getCurrentWatermarkInMs() * 1000 - self.window]
        times, values = times[order], values[order]
        name = int(times[0] // self.window)
        for other in names:
            if other != name:
                self.buckets.removeKey((other,))
        self.buckets.updateValue((name,), (times.tobytes(), values.tobytes()))
        if not len(seen) or self._end(seen) != self._end(times):
            if len(seen):
                self.handle.deleteTimer(self._end(seen))
            self.handle.registerTimer(self._end(times))
        yield pd.DataFrame({"txn_id": rows["txn_id"], "account_id": key[0], "ts": rows["ts"], "vel_count": counts.astype(np.int32), "vel_amount": sums})

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.buckets.clear()  # there is one timer an account, at the end of its last row
        return iter([])

    def close(self) -> None:
        pass


def velocity(stream: DataFrame, seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """Trailing count and sum per account, as each transaction comes; rows of a batch count in order of (ts, txn_id).

    A row that is late, but not behind the watermark, finds its neighbours. Rows without a time are left out. A null
    amount counts as 0 in the sum. stream has txn_id, account_id, ts, amount. The session is set to the state store that
    timers need.
    """
    ship(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = stream.select("txn_id", "account_id", "ts", "amount").where("ts IS NOT NULL").withWatermark("ts", lateness)
    return marked.groupBy("account_id").transformWithStateInPandas(Trailing(seconds), OUTPUT, "append", "EventTime")


def joined_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, before: int, after: int = 0, lateness: str = "10 minutes") -> DataFrame:
    """Pairs of rows of two streams with equal keys, the right one from `before` seconds before the left one to `after` after it.

    Both streams have a watermark, so rows of either are kept only while a partner may still come. Columns of the two
    must differ in name, but for the keys.
    """
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys}).withWatermark(right_time, lateness)
    seconds = lambda n: F.expr(f"INTERVAL {n} SECOND")
    same = [F.col(k) == F.col(f"__r_{k}") for k in keys]
    near = [F.col(right_time) >= F.col(left_time) - seconds(before), F.col(right_time) <= F.col(left_time) + seconds(after)]
    return left.withWatermark(left_time, lateness).join(right, [*same, *near]).drop(*[f"__r_{k}" for k in keys])


def windowed_totals(stream: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(start, end, account_id, n, total) of tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", lateness).groupBy(w.alias("w"), "account_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "account_id", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(start, end, account_id, n, total) of sessions without a longer gap."""
    out = stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "account_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "account_id", "n", "total")


def first_seen(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The stream without repeated transactions."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["txn_id"])
