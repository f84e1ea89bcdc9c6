"""Client settings, resolved once on the driver: explicit, then previous, then default."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

# fixed values
REDACT_KEYS = ("email", "phone", "name", "address", "token", "password", "secret", "cookie", "session", "auth", "ssn", "dob", "user")
REDACTED = "[REDACTED]"
QUEUE_PREFIX = "emberlog.queue"
CHANNELS, RUNTIMES = ("frontend", "backend"), ("browser", "server")


def positive_integer(value: Any, default: int) -> int:
    """Rounded down; what isn't a finite number above 0 gives the default."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return default
    return math.floor(value) if math.floor(value) > 0 else default


def at_least(value: Any, default: int, minimum: int) -> int:
    return max(positive_integer(value, default), minimum)


def redact_keys(keys: Sequence[str] | None) -> tuple[str, ...]:
    """Trimmed, lower case, distinct; none left gives the defaults."""
    found = [k.strip().lower() for k in (REDACT_KEYS if keys is None else keys)]
    return tuple(dict.fromkeys(k for k in found if k)) or REDACT_KEYS


def storage_segment(source: str) -> str:
    return re.sub(r"[^a-z0-9._-]+", "-", source.strip().lower()) or "unknown-source"


def default_storage_key(source: str, channel: str) -> str:
    return f"{QUEUE_PREFIX}.{channel}.{storage_segment(source)}"


#: setting: default and minimum
_LIMITS = {"max_message_length": (240, 16), "max_stack_length": (1800, 32), "max_component_stack_length": (1800, 32), "max_context_depth": (4, 1), "max_context_breadth": (20, 1), "max_tag_count": (10, 1), "threshold_count": (5, 1), "threshold_window_ms": (300_000, 1000)}


@dataclass(frozen=True)
class ErrorReporting:
    enabled: bool = True
    secure_endpoint_only: bool = True
    max_message_length: int = 240
    max_stack_length: int = 1800
    max_component_stack_length: int = 1800
    max_context_depth: int = 4
    max_context_breadth: int = 20
    max_tag_count: int = 10
    threshold_count: int = 5
    threshold_window_ms: int = 300_000
    redact_keys: tuple[str, ...] = REDACT_KEYS
    on_threshold_reached: Callable[[dict], None] | None = None

    @classmethod
    def resolve(cls, given: Mapping[str, Any] | None = None, previous: ErrorReporting | None = None) -> ErrorReporting:
        given = {k: v for k, v in (given or {}).items() if v is not None}
        was = previous or cls()
        limits = {k: at_least(given.get(k, getattr(was, k)), default, least) for k, (default, least) in _LIMITS.items()}
        keys = redact_keys(given.get("redact_keys", previous.redact_keys if previous else None))
        others = {k: given.get(k, getattr(was, k)) for k in ("enabled", "secure_endpoint_only", "on_threshold_reached")}
        return cls(**others, **limits, redact_keys=keys)


@dataclass(frozen=True)
class Config:
    source: str
    channel: str
    runtime: str
    session_id: str
    storage_key: str
    endpoint: str | None = None
    inject_channel_context: bool = True
    enabled: bool = True
    default_context: Mapping[str, Any] = field(default_factory=dict)
    headers: Mapping[str, str] = field(default_factory=lambda: {"content-type": "application/json"})
    flush_interval_ms: int = 5000
    batch_size: int = 20
    max_queue_size: int = 500
    errors: ErrorReporting = field(default_factory=ErrorReporting)
    transport: Callable[[dict], None] | None = None
    on_error: Callable[[Exception], None] | None = None

    @classmethod
    def resolve(cls, previous: Config | None = None, **given: Any) -> Config:
        """An ``endpoint`` of None keeps the previous one, a blank one clears it. A blank source raises ValueError."""
        given = {k: v for k, v in given.items() if v is not None}
        pick = lambda k, default: given.get(k, getattr(previous, k) if previous else default)
        source = str(pick("source", "")).strip()
        if not source:
            raise ValueError("a source is needed and must not be blank")
        runtime = pick("runtime", "server")
        channel = pick("channel", "backend" if runtime == "server" else "frontend")
        session = str(given.get("session_id", "")).strip() or (previous.session_id if previous else f"session_{uuid.uuid4().hex}")
        key = str(given.get("storage_key", "")).strip()
        if not key:
            own = default_storage_key(source, channel)
            kept = previous is not None and previous.storage_key != default_storage_key(previous.source, previous.channel)
            key = previous.storage_key if kept else own
        return cls(
            source=source,
            channel=channel,
            runtime=runtime,
            session_id=session,
            storage_key=key,
            endpoint=str(pick("endpoint", "") or "").strip() or None,
            inject_channel_context=pick("inject_channel_context", True),
            enabled=pick("enabled", True),
            default_context={**(previous.default_context if previous else {}), **given.get("default_context", {})},
            headers={"content-type": "application/json", **(previous.headers if previous else {}), **given.get("headers", {})},
            flush_interval_ms=positive_integer(pick("flush_interval_ms", None), 5000),
            batch_size=positive_integer(pick("batch_size", None), 20),
            max_queue_size=positive_integer(pick("max_queue_size", None), 500),
            errors=ErrorReporting.resolve(given.get("errors"), previous.errors if previous else None),
            transport=pick("transport", None),
            on_error=pick("on_error", None),
        )

    def with_channel(self, channel: str) -> Config:
        return replace(self, channel=channel)


def frontend(**given: Any) -> Config:
    return Config.resolve(**{"runtime": "browser", "channel": "frontend", **given})


def backend(**given: Any) -> Config:
    return Config.resolve(**{"runtime": "server", "channel": "backend", **given})
