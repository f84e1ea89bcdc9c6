"""Delivery of a stream of records: every micro-batch is cut into envelopes and sent.

Offsets are committed after a micro-batch was sent, so delivery is at least once; a transport that
fails stops the batch, which is sent again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..functions.text import secure_endpoint
from ..operators.delivery import cut_batches, envelopes
from ..sources.shared import stored


def envelope_id(queue: str, first: int, last: int) -> str:
    """Of a queue's envelope from its first to its last record, so the same whenever it is made again."""
    return hashlib.sha256(f"{queue}\0{first}\0{last}".encode()).hexdigest()[:32]


def http_post(request: dict) -> None:
    """POST of an envelope; an answer other than 2xx raises."""
    import urllib.request

    sent = urllib.request.Request(request["endpoint"], request["body"].encode(), request["headers"], method="POST")
    with urllib.request.urlopen(sent, timeout=30) as answer:
        if not 200 <= answer.status < 300:
            raise OSError(f"transport failed with status {answer.status}")


def send_batch(records: DataFrame, cfg: Config, sent_at_ms: int) -> DataFrame:
    """Sends the admitted envelopes from the executors; returns those that stay: refused ones, and all without an endpoint.

    The envelopes are made once, as a stored table, and read from there for what follows, so ids and texts don't differ between passes.
    """
    made = stored(envelopes(cut_batches(records, cfg.batch_size), cfg, sent_at_ms), "envelopes")
    if not cfg.endpoint:
        return made.drop("has_error")
    open_ = F.lit(not cfg.errors.secure_endpoint_only) | secure_endpoint(F.lit(cfg.endpoint)) | ~F.col("has_error")
    transport, endpoint, headers = (http_post if cfg.transport is None else cfg.transport), cfg.endpoint, dict(cfg.headers)

    def post(rows: Iterator) -> None:
        for row in rows:
            transport({"endpoint": endpoint, "body": row.body, "headers": {**headers, "idempotency-key": envelope_id(str(row.queue_key), row.first_seq, row.last_seq)}, "keepalive": False})

    made.where(open_).select(F.col("queue_key").cast("string").alias("queue_key"), "first_seq", "last_seq", "body").foreachPartition(post)
    return made.where(~open_).drop("has_error")


def is_secure(spark: SparkSession, endpoint: str) -> bool:
    return bool(spark.range(1).select(secure_endpoint(F.lit(endpoint))).first()[0])


def deliver(records: DataFrame, cfg: Config, checkpoint: str, clock: Callable[[], int], drain: bool = False, refused: Callable[[DataFrame], None] | None = None, dead_letters: str | None = None) -> StreamingQuery:
    """Starts delivery every flush interval; ``drain``: sends what is there and stops.

    Nothing waits here, see queues.deliver_queues() for that. So an endpoint is needed, and a place for envelopes that it may not have:
    ``refused`` gets them; they are also appended to the Parquet
    table ``dead_letters``, with ``batch_id`` (a repeated micro-batch replaces its own) and ``reason``.
    """
    if not cfg.endpoint:
        raise ValueError("delivery needs an endpoint; deliver_queues() lets records wait for one")
    if refused is None and dead_letters is None and cfg.errors.secure_endpoint_only and not is_secure(records.sparkSession, cfg.endpoint):
        raise ValueError(f"errors may not go to {cfg.endpoint}: name dead_letters or refused, or let them wait with deliver_queues()")

    def each(batch: DataFrame, batch_id: int) -> None:
        left = send_batch(batch, cfg, clock())
        if dead_letters is not None:
            left.withColumn("reason", F.lit(f"errors need an https or local endpoint, not {cfg.endpoint}")).write.mode("overwrite").parquet(f"{dead_letters.rstrip('/')}/batch_id={batch_id}")
        if refused is not None:
            refused(left)

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{cfg.flush_interval_ms} milliseconds")).start()
