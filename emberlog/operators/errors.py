"""Error reports: extraction, sanitizing, fingerprints, gates and records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config, ErrorReporting
from ..functions import text
from ..functions.context import clean_tree
from ..functions.hashing import fingerprint
from ..schema import ERROR
from .identity import crash_identity


def extract(df: DataFrame) -> DataFrame:
    """name, message and stack of the columns ``error`` (struct) or ``raw`` (text).

    A struct without a usable message gives itself as JSON; without either column's value the error is unknown. The optional
    column ``thrown`` says what was thrown: for ``error``, a real one, only an empty name or message has a stand-in; for ``other``,
    what is neither an error, an object nor a text, ``raw`` is its text.
    """
    e = F.col("error") if "error" in df.columns else F.lit(None).cast("struct<name:string,message:string,stack:string>")
    raw = F.col("raw") if "raw" in df.columns else F.lit(None).cast("string")
    blank = lambda c: F.length(text.trim(F.coalesce(c, F.lit("")))) == 0
    thrown = F.col("thrown") if "thrown" in df.columns else F.lit(None).cast("string")
    real, other = e.isNotNull() & (F.coalesce(thrown, F.lit("")) == "error"), F.coalesce(thrown, F.lit("")) == "other"
    empty = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    name = F.when(other, "UnknownError").when(real, empty(e["name"], "Error")).when(e.isNotNull(), F.when(blank(e["name"]), "Error").otherwise(e["name"])).when(raw.isNotNull(), "Error").otherwise("UnknownError")
    message = F.when(other, text.or_else(text.single_line(raw, 240), "Unknown error")).when(real, empty(e["message"], "Unknown error")).when(e.isNotNull(), F.when(blank(e["message"]), text.single_line(F.to_json(e), 240)).otherwise(e["message"])).when(raw.isNotNull(), raw).otherwise("Unknown error")
    return df.withColumns({"_name": name, "_message": message, "_stack": F.when(e.isNotNull() & ~other, e["stack"])})


def details(boundary: Column, name: Column, message: Column, stack: Column, component_stack: Column, handled: Column, severity: Column, tags: Column, cfg: ErrorReporting, known: Column | None = None) -> Column:
    """The sanitized error as a struct. A known fingerprint that isn't blank wins over the computed one."""
    b = text.or_else(text.single_line(boundary, 100), "UnknownErrorBoundary")
    n = text.or_else(text.single_line(name, 80), "Error")
    m = text.or_else(text.single_line(message, cfg.max_message_length), "Unknown error")
    some = lambda c, most: F.when(F.length(c) > 0, text.multi_line(c, most))
    s, level = some(stack, cfg.max_stack_length), F.when(severity == "fatal", "fatal").otherwise("error")
    clean = F.struct(b.alias("boundary"), n.alias("name"), m.alias("message"), level.alias("severity"), s.alias("stack"))

    def whole(x: Column) -> Column:
        mark = fingerprint(x["boundary"], x["name"], x["message"], x["stack"], x["severity"])
        if known is not None:
            mark = text.or_else(text.single_line(known, 120), mark)
        return F.struct(x["boundary"].alias("boundary"), x["name"].alias("name"), x["message"].alias("message"), mark.alias("fingerprint"), F.coalesce(handled, F.lit(True)).alias("handled"), x["severity"].alias("severity"), x["stack"].alias("stack"), some(component_stack, cfg.max_component_stack_length).alias("component_stack"), text.tags(tags, cfg.max_tag_count, cfg.max_message_length).alias("tags"))

    return text.let(clean, whole)


def is_error(e: Column) -> Column:
    """Are the four texts there that an error needs?"""
    return e["boundary"].isNotNull() & e["name"].isNotNull() & e["message"].isNotNull() & e["fingerprint"].isNotNull()


def stored_error(e: Column | None, cfg: ErrorReporting) -> Column:
    """An error that was normalized before, sanitized again with its fingerprint; null if it isn't complete."""
    if e is None:
        return F.lit(None).cast(ERROR)
    return F.when(is_error(e), details(e["boundary"], e["name"], e["message"], e["stack"], e["component_stack"], e["handled"], e["severity"], e["tags"], cfg, e["fingerprint"])).cast(ERROR)


def _given(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def normalize_errors(reports: DataFrame, cfg: Config) -> DataFrame:
    """reports (REPORT's columns; optional ones may be missing) with ``details``, the sanitized error."""
    df = extract(reports)
    made = details(F.col("boundary"), F.col("_name"), F.col("_message"), F.col("_stack"), _given(df, "component_stack", "string"), _given(df, "handled", "boolean"), _given(df, "severity", "string"), _given(df, "tags", "array<string>"), cfg.errors)
    return df.withColumn("details", made).drop("_name", "_message", "_stack")


def gated(reports: DataFrame, cfg: Config) -> DataFrame:
    """No reports if the client or its error reporting is off, or if the endpoint isn't secure."""
    if not (cfg.enabled and cfg.errors.enabled):
        return reports.where(F.lit(False))
    if cfg.errors.secure_endpoint_only and cfg.endpoint:
        return reports.where(text.secure_endpoint(F.lit(cfg.endpoint)))
    return reports


def _json(value: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), '(?s)^\\{"v":(.*)\\}$', 1)


def error_context(clean: Column, error: Column, identity: Column) -> Column:
    """The sanitized context with what is known of the error; same-named keys of the user lose."""
    names = ("errorFingerprint", "errorBoundary", "errorSeverity", "errorHandled", "clientIdentity", "errorTags")
    values = (_json(error["fingerprint"]), _json(error["boundary"]), _json(error["severity"]), error["handled"].cast("string"), identity, F.to_json(error["tags"]))
    pairs = F.array(*[F.when(v.isNotNull(), F.concat(F.lit(json.dumps(k) + ":"), v)) for k, v in zip(names, values, strict=True)])
    added = F.concat(F.lit("{"), F.array_join(F.filter(pairs, lambda x: x.isNotNull()), ","), F.lit("}"))
    from ..functions.context import merge_json

    return F.when(clean == "{}", added).otherwise(merge_json(clean, added))


def errors_to_records(reports: DataFrame, cfg: Config, now_ms: int | None = None) -> DataFrame:
    """Records of error reports: sanitized error and context, pseudonymous identity, default and channel context."""
    from .records import merged_context

    df = normalize_errors(gated(reports, cfg), cfg)
    channel = F.coalesce(_given(df, "channel", "string"), F.lit(cfg.channel))
    now = F.lit(now_ms).cast("long") if now_ms is not None else F.unix_millis(F.current_timestamp())
    df = df.withColumn("_clean", clean_tree(_given(df, "context", "string"), cfg.errors))
    d = F.col("details")
    context = error_context(F.col("_clean.context"), d, F.to_json(crash_identity(df, cfg, F.col("_clean.identifiers"))))
    df = df.withColumn("_context", context)
    none = F.lit(None).cast("string")
    return df.select(
        F.coalesce(_given(df, "id", "string"), F.concat(F.lit("event_"), F.uuid())).alias("id"),
        _given(df, "seq", "long").alias("seq"),
        F.lit("error").alias("kind"),
        d["boundary"].alias("component"),
        F.when(d["handled"], "error_boundary_caught").otherwise("unhandled_error").alias("action"),
        channel.alias("channel"),
        F.lit(cfg.runtime).alias("runtime"),
        d["fingerprint"].alias("label"),
        none.alias("href"),
        none.alias("variant"),
        none.alias("request_id"),
        F.lit(cfg.source).alias("source"),
        F.coalesce(_given(df, "session_id", "string"), F.lit(cfg.session_id)).alias("session_id"),
        F.coalesce(_given(df, "timestamp", "long"), now).alias("timestamp"),
        merged_context(F.col("_context"), channel, cfg).alias("context"),
        d.cast(ERROR).alias("error"),
    )
