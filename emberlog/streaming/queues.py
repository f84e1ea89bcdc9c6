"""Queues of a stream: what isn't sent yet waits in keyed state.

Every ``queue_key`` has a queue of at most ``max_queue_size`` records, the oldest go first. A queue of
``batch_size`` records sends its head at once, what is less goes when the flush interval ends. Only what was sent
leaves the queue: without an endpoint, or when the transport fails, or while the endpoint may not have errors, records
wait in state, through restarts, until the next interval. After a failure a queue doesn't try again before that.

An envelope's id follows from its queue and its first and last record. A task that is run again after it was lost
sends the same envelopes with the same ids in the header ``idempotency-key``, so a receiver that knows ids takes each once.

Rows of a micro-batch come in no order and are sorted by ``seq``: a task holds one queue's rows of one micro-batch, which
the source's rate limit bounds; without an endpoint it holds no more than a queue.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace
from heapq import nlargest
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import Config
from ..operators.delivery import event_json
from ..schema import state_store
from .callbacks import observed
from .delivery import envelope_id, http_post, is_secure

#: a row of the log: one try to send an envelope; status is sent, refused or failed
LOG = "queue_key string, envelope_id string, status string, n_events int, first_seq long, last_seq long, sent_at long, waiting int, reason string"
_STATE = "fresh boolean, seq long, kind string, event string"


class DeliveryQueue(StatefulProcessor):
    """A record is (fresh, seq, kind, event as JSON); restored ones aren't fresh and come before the others."""

    def __init__(self, cfg: Config, secure: bool, clock: Callable[[], int] | None = None):
        self.size, self.most, self.interval = cfg.batch_size, cfg.max_queue_size, cfg.flush_interval_ms
        self.endpoint, self.headers, self.transport, self.clock = cfg.endpoint if cfg.enabled else None, dict(cfg.headers), cfg.transport or http_post, clock
        self.closed_to_errors = cfg.errors.secure_endpoint_only and not secure
        self.head = {"source": cfg.source, "channel": cfg.channel, "runtime": cfg.runtime}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.queue = handle, handle.getListState("queue", _STATE)

    def _kept(self) -> list[tuple]:
        return sorted(tuple(x) for x in self.queue.get()) if self.queue.exists() else []

    def _keep(self, queue: list[tuple], now: int, ended: bool = False) -> None:
        """ended: is the queue's timer the one that has just ended?"""
        if queue:
            self.queue.put(queue)
            if ended or not list(self.handle.listTimers()):
                self.handle.registerTimer(now + self.interval)
        else:
            self.queue.clear()

    def _send(self, key: str, queue: list[tuple], now: int) -> tuple[bool, Row]:
        """Sends the head; is it away?"""
        batch = queue[: self.size]
        first, last = batch[0][1], batch[-1][1]
        ident, at = envelope_id(key, first, last), now if self.clock is None else self.clock()
        status, reason = "sent", None
        if self.closed_to_errors and any(x[2] == "error" for x in batch):
            status, reason = "refused", f"errors need an https or local endpoint, not {self.endpoint}"
        else:
            shown = json.dumps({**self.head, "sentAt": at}, separators=(",", ":"), ensure_ascii=False)
            body = f'{shown[:-1]},"events":[{",".join(x[3] for x in batch)}]}}'
            try:
                self.transport({"endpoint": self.endpoint, "body": body, "headers": {**self.headers, "idempotency-key": ident}, "keepalive": False})
            except Exception as error:  # the records stay; the log tells
                status, reason = "failed", f"{type(error).__name__}: {error}"
        waiting = len(queue) - len(batch) * (status == "sent")
        return status == "sent", Row(queue_key=key, envelope_id=ident, status=status, n_events=len(batch), first_seq=first, last_seq=last, sent_at=at, waiting=waiting, reason=reason)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        queue, now = self._kept(), timerValues.getCurrentProcessingTimeInMs()
        fresh = ((True, r.seq, r.kind, r.event) for r in rows)
        if not self.endpoint:
            fresh = nlargest(self.most, fresh)
        tries = bool(self.endpoint)
        for record in sorted(fresh):
            queue.append(record)
            if len(queue) > self.most:
                del queue[: len(queue) - self.most]
            if tries and len(queue) >= self.size:
                tries, told = self._send(key[0], queue, now)
                if tries:
                    del queue[: self.size]
                yield told
        self._keep(queue, now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        queue, now = self._kept(), timerValues.getCurrentProcessingTimeInMs()
        while queue and self.endpoint:
            away, told = self._send(key[0], queue, now)
            yield told
            if not away:
                break
            del queue[: self.size]
        self._keep(queue, now, ended=True)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        queue = sorted([*self._kept(), (False, initialState.seq, initialState.kind, initialState.event)])
        self._keep(queue[-self.most :], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def _rows(records: DataFrame) -> DataFrame:
    return records.select(F.col("queue_key").cast("string").alias("queue_key"), F.col("seq").cast("long").alias("seq"), "kind", event_json(records).alias("event"))


def _heartbeat(records: DataFrame) -> DataFrame:
    """A stream without rows that has something new every second: a query that was started again looks for timers only in a micro-batch, and makes none without news."""
    beat = records.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    return beat.where("value < 0").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema.fields])


def delivery_log(records: DataFrame, cfg: Config, restored: DataFrame | None = None, clock: Callable[[], int] | None = None) -> DataFrame:
    """Sends the records of a stream (queue_key, seq and a record's columns), queue by queue; the rows of LOG tell of every try.

    ``restored``: records of earlier queues, a table. They are in the queues when a new query begins.
    """
    spark = state_store(records.sparkSession)
    secure = bool(cfg.endpoint) and is_secure(spark, cfg.endpoint)
    processor = DeliveryQueue(replace(cfg, on_error=None, errors=replace(cfg.errors, on_threshold_reached=None)), secure, clock)
    initial = None if restored is None else _rows(restored).groupBy("queue_key")
    rows = _rows(records)
    return rows.unionByName(_heartbeat(rows)).groupBy("queue_key").transformWithState(processor, LOG, "append", "processingTime", initial)


def deliver_queues(records: DataFrame, cfg: Config, checkpoint: str, log: str, restored: DataFrame | None = None, clock: Callable[[], int] | None = None) -> StreamingQuery:
    """Starts delivery_log(); the log is appended to the Parquet table ``log``, and callbacks.listen() hears of what wasn't sent."""
    out = observed(delivery_log(records, cfg, restored, clock))
    return out.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(processingTime=f"{cfg.flush_interval_ms} milliseconds").start()
