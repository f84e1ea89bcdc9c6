"""Bounded queues, batches, admission and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import secure_endpoint
from .ranks import positions


def queue_cap(records: DataFrame, most: int, queue: Column | str = "queue_key", order: str = "seq") -> DataFrame:
    """The last ``most`` records of every queue. A queue is a client's, whatever the channels of its events."""
    w = Window.partitionBy(queue).orderBy(F.desc(order))
    return records.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def cut_batches(records: DataFrame, size: int, queue: str = "queue_key", order: str = "seq") -> DataFrame:
    """records with ``batch_no`` (from 0) and ``batch_pos`` within their queue. A queue with most of the rows is dealt by slices of its order."""
    n = F.col("_place")
    placed = positions(records, [queue], order, "_place")
    return placed.withColumns({"batch_no": F.floor(n / size).cast("long"), "batch_pos": (n % size).cast("int")}).drop("_place")


def admission(batches: DataFrame, endpoint: Column, secure_only: bool, keys: list[str]) -> DataFrame:
    """One row per batch: events, has_error and admitted. Refused batches don't hold up those behind them."""
    g = batches.groupBy(*keys).agg(F.count("*").alias("n_events"), F.bool_or(F.col("kind") == "error").alias("has_error"), F.first(endpoint).alias("endpoint"))
    open_ = F.coalesce(F.col("endpoint"), F.lit("")) == ""
    ok = open_ | F.lit(not secure_only) | secure_endpoint(F.col("endpoint")) | ~F.col("has_error")
    return g.withColumn("admitted", ok)


_EVENT = ("id", "component", "action", "kind", "channel", "runtime", "label", "href", "variant", "request_id", "source", "session_id", "timestamp")
_SHOWN = {"request_id": "requestId", "session_id": "sessionId"}


def event_json(df: DataFrame) -> Column:
    """A record as in an envelope: null fields are left out, the context keeps its nulls and order."""
    known = [c for c in _EVENT if c in df.columns]
    body = F.to_json(F.struct(*[F.col(c).alias(_SHOWN.get(c, c)) for c in known]))
    more = [F.concat(F.lit(',"context":'), F.coalesce(F.col("context"), F.lit("{}")))] if "context" in df.columns else []
    if "error" in df.columns:
        e = F.col("error")
        shown = F.to_json(F.struct(*[e[f].alias("componentStack" if f == "component_stack" else f) for f in ("boundary", "name", "message", "fingerprint", "handled", "severity", "stack", "component_stack", "tags")]))
        more.append(F.when(e.isNotNull(), F.concat(F.lit(',"error":'), shown)).otherwise(""))
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), *more, F.lit("}"))


def envelopes(batches: DataFrame, cfg: Config, sent_at_ms: int, queue: str = "queue_key") -> DataFrame:
    """One envelope per batch: its events in order, as JSON. A batch holds ``batch_size`` events at most."""
    rows = batches.withColumn("_json", event_json(batches))
    g = rows.groupBy(queue, "batch_no").agg(F.count("*").cast("int").alias("n_events"), F.bool_or(F.col("kind") == "error").alias("has_error"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.array_sort(F.collect_list(F.struct("batch_pos", "_json"))).alias("_events"))
    head = F.to_json(F.struct(F.lit(cfg.source).alias("source"), F.lit(cfg.channel).alias("channel"), F.lit(cfg.runtime).alias("runtime"), F.lit(sent_at_ms).cast("long").alias("sentAt")))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"events":['), F.array_join(F.transform("_events", lambda e: e["_json"]), ","), F.lit("]}"))
    return g.select(queue, "batch_no", F.lit(cfg.source).alias("source"), F.lit(cfg.channel).alias("channel"), F.lit(cfg.runtime).alias("runtime"), F.lit(sent_at_ms).cast("long").alias("sent_at"), "n_events", "has_error", "first_seq", "last_seq", body.alias("body"))
