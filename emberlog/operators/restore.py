"""Persisted queues read back: validated, defaulted, sanitized again."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHANNELS, RUNTIMES, Config
from ..functions.text import let
from ..schema import ERROR
from .errors import stored_error

_TEXTS = {"id": "id", "component": "component", "action": "action", "source": "source", "session_id": "sessionId"}
_DETAILS = {"boundary": "boundary", "name": "name", "message": "message", "fingerprint": "fingerprint", "severity": "severity", "stack": "stack", "component_stack": "componentStack"}
_MORE = {"label": "label", "href": "href", "variant": "variant", "request_id": "requestId"}
#: a stored record read in one pass: every field is a variant, which keeps the type that it was given
_STORED = (
    ", ".join(f"`{n}` variant" for n in (*_TEXTS.values(), *_MORE.values(), "timestamp", "kind", "channel", "runtime", "context"))
    + f", error struct<{', '.join(f'`{n}`: variant' for n in (*_DETAILS.values(), 'handled', 'tags'))}>"
)


def _text(v: Column) -> Column:
    """The value if it is a text."""
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def _is_number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.coalesce(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.lit(False))


def restore_queue(queues: DataFrame, cfg: Config, column: str = "value") -> DataFrame:
    """Records of the JSON arrays in ``column``; what isn't an array, or can't be read, gives none.

    A record needs its five texts and a number as timestamp. Channels, runtimes and kinds
    out of their domain get defaults; a context that isn't an object is {}. ``pos`` is the place in the array;
    other columns of queues stay.
    """
    others = [c for c in queues.columns if c != column]
    return restore_records(queues.select(*others, F.posexplode(F.from_json(column, "array<string>")).alias("pos", "item")), cfg)


def restore_records(items: DataFrame, cfg: Config) -> DataFrame:
    """The same of a table with one stored record a row: its JSON in ``item``, its place in ``pos``."""
    others = [c for c in items.columns if c not in ("pos", "item")]
    rows = items.withColumn("v", F.from_json("item", _STORED))
    v, e = F.col("v"), F.col("v.error")
    rows = rows.withColumns({f"_{n}": _text(v[shown]) for n, shown in _TEXTS.items()})
    rows = rows.where(reduce(and_, [F.col(f"_{n}").isNotNull() for n in _TEXTS], _is_number(v["timestamp"])))

    def domain(field: str, known: tuple[str, ...], default: str) -> Column:
        return let(_text(v[field]), lambda x: F.when(x.isin(*known), x).otherwise(F.lit(default)))

    kind = F.when(_text(v["kind"]) == "error", "error").otherwise("interaction")
    handled = F.when(F.schema_of_variant(e["handled"]) == "BOOLEAN", e["handled"].try_cast("boolean"))
    details = {n: _text(e[shown]) for n, shown in _DETAILS.items()} | {"handled": handled, "tags": e["tags"].try_cast("array<string>")}
    error = F.struct(*[details[n].alias(n) for n in ERROR.names])
    return rows.select(
        *others,
        "pos",
        *[F.col(f"_{n}").alias(n) for n in _TEXTS],
        kind.alias("kind"),
        domain("channel", CHANNELS, cfg.channel).alias("channel"),
        domain("runtime", RUNTIMES, cfg.runtime).alias("runtime"),
        *[_text(v[shown]).alias(n) for n, shown in _MORE.items()],
        v["timestamp"].try_cast("double").cast("long").alias("timestamp"),
        F.when(F.schema_of_variant(v["context"]).startswith("OBJECT"), F.get_json_object("item", "$.context")).otherwise("{}").alias("context"),
        F.when(kind == "error", stored_error(error, cfg.errors)).otherwise(F.lit(None).cast(ERROR)).alias("error"),
    )


def persist_records(records: DataFrame, most: int | None = None, queue: str = "queue_key") -> DataFrame:
    """One row per record: its queue, ``pos`` (its seq) and ``item`` (its JSON), as restore_records() reads it. ``most``: what a queue keeps."""
    from .delivery import event_json, queue_cap

    kept = records if most is None else queue_cap(records, most, queue)
    return kept.select(queue, F.col("seq").alias("pos"), event_json(kept).alias("item"))


def persist_queue(records: DataFrame, queue: str = "queue_key", most: int = 500) -> DataFrame:
    """One row per queue: its last ``most`` records in order as one JSON array, as restore_queue() reads it."""
    rows = persist_records(records, most, queue)
    g = rows.groupBy(queue).agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("_all"))
    return g.select(queue, F.concat(F.lit("["), F.array_join(F.transform("_all", lambda x: x["item"]), ","), F.lit("]")).alias("value"))
