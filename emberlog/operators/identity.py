"""The client's identity, with fields kept or hashed by a declared policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.hashing import salted_hash, storage_hash

# fixed values: field, its name in the payload, kept or hashed
POLICY = (
    ("source", "source", "keep"),
    ("channel", "channel", "keep"),
    ("runtime", "runtime", "keep"),
    ("session_id", "sessionId", "hash"),
    ("user_agent", "userAgent", "hash"),
    ("platform", "platform", "hash"),
    ("language", "language", "hash"),
    ("timezone", "timezone", "hash"),
    ("origin", "origin", "hash"),
    ("pathname", "pathname", "hash"),
    ("screen_width", "screenWidth", "keep"),
    ("screen_height", "screenHeight", "keep"),
    ("color_depth", "colorDepth", "keep"),
    ("hardware_concurrency", "hardwareConcurrency", "keep"),
)


def pseudonym(value: Column, salt: str | None = None) -> Column:
    return storage_hash(value) if salt is None else salted_hash(value, salt)


def identifiers_hashed(identifiers: Column, most: int, salt: str | None = None) -> Column:
    """(key, valueHash) of the first identifiers; null if there are none."""
    kept = F.transform(F.slice(identifiers, 1, most), lambda e: F.struct(e["key"].alias("key"), pseudonym(e["value"], salt).alias("valueHash")))
    return F.when(F.size(identifiers) > 0, kept)


def crash_identity(df: DataFrame, cfg: Config, identifiers: Column | None = None, salt: str | None = None) -> Column:
    """The identity struct: settings of the client, browser fields that df has as columns, and hashed identifiers."""
    own = {"source": F.lit(cfg.source), "channel": F.lit(cfg.channel), "runtime": F.lit(cfg.runtime), "session_id": F.coalesce(F.col("session_id"), F.lit(cfg.session_id)) if "session_id" in df.columns else F.lit(cfg.session_id)}
    browser = {n for n, _, _ in POLICY[4:] if n in df.columns} if cfg.runtime == "browser" else set()
    fields = []
    for name, shown, action in POLICY:
        if name in own or name in browser:
            value = own.get(name, F.col(name) if name in browser else None)
            fields.append(pseudonym(value.cast("string"), salt).alias(f"{shown}Hash") if action == "hash" else value.alias(shown))
    if identifiers is not None:
        fields.append(identifiers_hashed(identifiers, cfg.errors.max_context_breadth, salt).alias("identifiers"))
    return F.struct(*fields)
