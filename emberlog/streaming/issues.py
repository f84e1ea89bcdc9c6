"""Issue counts and triggers over a stream, with keyed state.

State of a fingerprint: the timestamps in its window (a heap) and when it fired last. Rows of a
micro-batch come in no order, so they are sorted by seq. There is no watermark: late
errors count as they do in the batch form. ``ttl_ms`` bounds the state of keys that fell silent; it
must be the window at least, and is by processing time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import BLOCK_ROWS
from ..operators.issues import arrived, errors_of
from ..operators.ranks import slice_of, split_points
from ..schema import state_store
from ..sources.shared import stored

OUT = "fingerprint string, seq long, timestamp long, cnt long, fired boolean"


class IssueState(StatefulProcessor):
    def __init__(self, threshold: int, window_ms: int, ttl_ms: int | None):
        self.threshold, self.window, self.ttl = threshold, window_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("issue", "alive array<long>, last long", self.ttl)

    def _kept(self) -> tuple[list[int], int | None]:
        if not self.state.exists():
            return [], None
        got = self.state.get()
        return list(got[0]), got[1]

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Restored errors are counted, never fire and set no cooldown. They come sorted, as one array a key."""
        alive, _ = self._kept()
        for x in initialState["times"].iloc[0]:
            arrived(alive, int(x), self.window)
        self.state.update((alive, None))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        alive, last = self._kept()
        pdf = pd.concat(list(rows)).sort_values("seq")
        counts, fired = [], []
        for t in pdf["timestamp"].tolist():
            n = arrived(alive, t, self.window)
            ok = n >= self.threshold and (last is None or t - last >= self.window)
            last = t if ok else last
            counts.append(n)
            fired.append(ok)
        self.state.update(([int(x) for x in alive], None if last is None else int(last)))
        yield pd.DataFrame({"fingerprint": key[0], "seq": pdf["seq"].to_numpy(), "timestamp": pdf["timestamp"].to_numpy(), "cnt": counts, "fired": fired})

    def close(self) -> None:
        pass


def _seeds(restored: DataFrame, window_ms: int) -> DataFrame:
    """fingerprint and the times of its restored errors in order of arrival, without those that errors of later slices of arrivals put out of the window."""
    e = stored(errors_of(restored).select("seq", "fingerprint", "timestamp"), "restored")
    cut = e.withColumn("_slice", slice_of(F.col("seq"), split_points(e.select("seq"), "seq", BLOCK_ROWS)))
    behind = Window.partitionBy("fingerprint").orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    tops = cut.groupBy("fingerprint", "_slice").agg(F.max("timestamp").alias("_top")).withColumn("_later", F.max("_top").over(behind)).drop("_top")
    alive = cut.join(tops, ["fingerprint", "_slice"]).where(F.col("_later").isNull() | (F.col("timestamp") >= F.col("_later") - window_ms))
    return alive.groupBy("fingerprint").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "timestamp"))), lambda x: x["timestamp"]).alias("times"))


def issue_stream(records: DataFrame, threshold: int, window_ms: int, ttl_ms: int | None = None, restored: DataFrame | None = None) -> DataFrame:
    """fingerprint, seq, timestamp, cnt and fired of every error of a stream (RocksDB state store).

    ``restored``: records of an earlier queue, a table; they are in the state when a new query begins.
    """
    if ttl_ms is not None and ttl_ms < window_ms:
        raise ValueError("state must live as long as the window")
    state_store(records.sparkSession)
    e = errors_of(records).select("seq", "timestamp", "fingerprint")
    mode = "ProcessingTime" if ttl_ms is not None else "None"
    initial = None if restored is None else _seeds(restored, window_ms).groupBy("fingerprint")
    return e.groupBy("fingerprint").transformWithStateInPandas(IssueState(threshold, window_ms, ttl_ms), OUT, "append", mode, initial)
