"""Ordered walks (C12, the throttle of Q6) on streams.

``walk_stream`` keeps per key where the walker stands (lane, time it waits
for, time of the last row) and the rows that are not yet in order.  Rows wait
until the watermark has passed them, so a batch may hold them in any order; an
event-time timer then hands them to the same rule as the batch operator.  A key
that has been quiet for the rule's memory is forgotten by another timer, which
leaves it in the state of a new one.

The state store must be RocksDB's (``use_rocksdb``), which ``transformWithState``
asks for; its files are under the query's checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from gatewise.operators.walks import NEVER, START, Rule, State, failure_rule, marked, spacing_rule, step_state

OUT = "key string, id string, ts timestamp, visited boolean, lane long, jumped boolean, waits_us long"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that the walks need, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


class _Walker(StatefulProcessor):
    def __init__(self, rule: Rule, lanes: int, memory_us: int):
        self.rule, self.lanes, self.memory_us = rule, lanes, memory_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "lane long, until long, last_us long")
        self.waiting = handle.getListState("waiting", "us long, id string, mark boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            us = pdf["us"].tolist()
            self.waiting.appendList(list(zip(us, pdf["id"].tolist(), pdf["mark"].tolist(), strict=True)))
            latest = max([*us, latest]) if latest is not None else max(us)
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)  # once the watermark is beyond these rows
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_us = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted((us, row_id, mark) for us, row_id, mark in self.waiting.get())
        due, later = [r for r in rows if r[0] < now_us], [r for r in rows if r[0] >= now_us]
        lane, until, last = self.at.get() if self.at.exists() else (*START, NEVER // 2)
        if not due:
            if not later and now_us > last + self.memory_us:
                self.at.clear()  # nothing before can matter any more
            yield pd.DataFrame()
            return
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        t = np.array([r[0] for r in due], np.int64)
        gaps = np.diff(t, prepend=np.int64(last))
        marks = np.array([r[2] for r in due], bool)
        at = State(int(lane), int(until))
        visited, behind, jumped, waits = marked(t, gaps, marks, self.rule, self.lanes, at)
        after = step_state(t, visited, behind, jumped, waits, at, self.rule, gaps, marks)
        self.at.update((after.lane, after.until, int(t[-1])))
        self.handle.registerTimer(int(t[-1] + self.memory_us) // 1000 + 2)
        yield pd.DataFrame({"key": [key[0]] * len(due), "id": [r[1] for r in due], "ts": pd.to_datetime(t, unit="us"), "visited": visited, "lane": behind, "jumped": jumped, "waits_us": waits})

    def close(self) -> None:
        pass


def walk_stream(events: DataFrame, key: str, ts_col: str, id_col: str, mark: str | None, rule: Rule, lanes: int, memory_s: float, watermark: str = "2 minutes") -> DataFrame:
    """``operators.walks.walk`` on a stream: (key, id, ts, visited, lane, jumped, waits_us), once the watermark has passed a row.

    Rows later than the watermark are dropped by Spark; null times and null marks count as no event and False.
    """
    ts = F.col(ts_col).cast("timestamp")
    rows = events.where(ts.isNotNull()).select(
        F.col(key).cast("string").alias("key"), ts.alias("ts"), F.unix_micros(ts).alias("us"), F.col(id_col).cast("string").alias("id"), (F.lit(True) if mark is None else F.coalesce(F.col(mark), F.lit(False))).alias("mark")
    )
    return rows.withWatermark("ts", watermark).groupBy("key").transformWithStateInPandas(_Walker(rule, lanes, int(memory_s * 1_000_000)), OUT, "Append", "EventTime")


def shadow_disable_stream(outcomes: DataFrame, key: str, ts_col: str = "ts", id_col: str = "id", threshold: int = 3, window_s: float = 300.0, disable_s: float = 300.0, watermark: str = "2 minutes") -> DataFrame:
    """C12 on a stream: (key, id, ts, skipped, tripped, fail_count)."""
    found = walk_stream(outcomes, key, ts_col, id_col, "success", failure_rule(threshold, window_s, disable_s), threshold, max(window_s, disable_s), watermark)
    return found.select("key", "id", "ts", (~F.col("visited")).alias("skipped"), F.col("jumped").alias("tripped"), F.col("lane").alias("fail_count"))


def throttle_stream(exhausted: DataFrame, key: str, ts_col: str = "ts", id_col: str = "event_id", window_s: float = 60.0, watermark: str = "2 minutes") -> DataFrame:
    """Q6 throttle on a stream of exhausted requests: (key, id, ts, admitted, retry_after)."""
    found = walk_stream(exhausted, key, ts_col, id_col, None, spacing_rule(window_s), 1, window_s, watermark)
    left = F.ceil((F.col("waits_us") - F.unix_micros("ts")) / 1_000_000).cast("long")
    return found.select("key", "id", "ts", F.col("visited").alias("admitted"), F.when(~F.col("visited"), left).alias("retry_after"))
