"""Events to records: normalizing, channels, contexts and gates."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..functions.context import merge_json
from .errors import stored_error


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or nulls where the table has none."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def inject_channel(context: Column, channel: Column, runtime: Column) -> Column:
    """The context object with analyticsChannel and analyticsRuntime where it has no such key; a null value counts as there."""
    body = F.trim(context)
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))

    def pair(key: str, value: Column) -> Column:
        shown = F.to_json(F.struct(value.alias(key)))
        return F.when(~F.array_contains(keys, key), F.substring(shown, F.lit(2), F.length(shown) - 2))

    added = F.concat_ws(",", pair("analyticsChannel", channel), pair("analyticsRuntime", runtime))
    opened = F.rtrim(F.substring(body, F.lit(1), F.length(body) - 1))
    return F.when(added == "", body).otherwise(F.concat(opened, F.when(F.size(keys) > 0, ",").otherwise(""), added, F.lit("}")))


def is_object(value: Column) -> Column:
    return F.coalesce(F.trim(value).startswith("{") & F.json_object_keys(value).isNotNull(), F.lit(False))


def merged_context(context: Column, channel: Column, cfg: Config) -> Column:
    """Defaults, then the event's own keys, then the channel where it is missing. What isn't an object is {}."""
    own = F.when(is_object(context), context).otherwise("{}")
    if cfg.default_context:
        own = merge_json(F.lit(json.dumps(dict(cfg.default_context))), own)
    return inject_channel(own, channel, F.lit(cfg.runtime)) if cfg.inject_channel_context else own


def normalize_events(events: DataFrame, cfg: Config, now_ms: int | None = None) -> DataFrame:
    """Complete records of events (EVENT's columns; optional ones may be missing).

    Texts are copied as they are. An error is kept only if the kind is 'error' and its
    boundary, name, message and fingerprint are there; it is then sanitized again.
    ``now_ms``: time of events without one; the wall clock if None.
    """
    if not cfg.enabled:
        events = events.where(F.lit(False))
    channel = F.coalesce(_column(events, "channel"), F.lit(cfg.channel))
    kind = F.when(_column(events, "kind") == "error", "error").otherwise("interaction")
    now = F.lit(now_ms).cast("long") if now_ms is not None else F.unix_millis(F.current_timestamp())
    ident = F.coalesce(_column(events, "id"), F.concat(F.lit("event_"), F.uuid()))
    error = stored_error(F.col("error"), cfg.errors) if "error" in events.columns else stored_error(None, cfg.errors)
    return events.select(
        ident.alias("id"),
        _column(events, "seq", "long").alias("seq"),
        kind.alias("kind"),
        "component",
        "action",
        channel.alias("channel"),
        F.lit(cfg.runtime).alias("runtime"),
        *[_column(events, c).alias(c) for c in ("label", "href", "variant")],
        F.nullif(text.trim(_column(events, "request_id")), F.lit("")).alias("request_id"),
        F.lit(cfg.source).alias("source"),
        F.coalesce(_column(events, "session_id"), F.lit(cfg.session_id)).alias("session_id"),
        F.coalesce(_column(events, "timestamp", "long"), now).alias("timestamp"),
        merged_context(_column(events, "context"), channel, cfg).alias("context"),
        F.when(kind == "error", error).alias("error"),
    )


def pinned(events: DataFrame, channel: str) -> DataFrame:
    """All events on one channel, whatever they say."""
    return events.withColumn("channel", F.lit(channel))


def mixed_channels(frontend: DataFrame, backend: DataFrame) -> DataFrame:
    return pinned(frontend, "frontend").unionByName(pinned(backend, "backend"), allowMissingColumns=True)


def bind_component(component: str, base_context: Mapping | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function that turns (action, ...) rows into events of the component: base context, then the row's.

    Only interactions can be made this way: kind and error are dropped.
    """
    base = json.dumps(dict(base_context or {}))

    def bind(rows: DataFrame) -> DataFrame:
        own = F.col("context") if "context" in rows.columns else F.lit("{}")
        out = rows.withColumns({"component": F.lit(component), "context": merge_json(F.lit(base), F.coalesce(own, F.lit("{}")))})
        return out.drop("kind", "error")

    return bind


def merge_maps(default: Column, event: Column) -> Column:
    """Keys of both maps; the event's values win. Works under any map policy of the session."""
    kept = F.map_filter(F.coalesce(default, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: F.coalesce(~F.map_contains_key(event, k), F.lit(True)))
    return F.when(event.isNull(), default).otherwise(F.map_concat(kept, event))
