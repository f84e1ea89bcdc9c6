"""The text functions in plain Python, for the tree walk and as a test model."""

from __future__ import annotations

import re

from ..config import REDACTED
from .hashing import FACTOR, SEED
from .text import BLANKS

SPACE = "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# fixed values: patterns. Bodies of the first and third begin with a whole run of characters (see text.py).
_EMAIL, _PARTS = r"[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+\b"
_EMAILS = re.compile(rf"\b{_EMAIL}", re.I | re.A), re.compile(rf"(?<![A-Z0-9._%+-])([.%+-]*+){_EMAIL}", re.I | re.A)
_THREE_PARTS = re.compile(rf"\b{_PARTS}", re.A), re.compile(rf"(?<![A-Za-z0-9_-])(-*+){_PARTS}", re.A)
_BEARER = re.compile(rf"\bBearer{SPACE}++[A-Z0-9._-]+\b", re.I | re.A)
_DIGITS = re.compile(r"\b[0-9]{9,}+\b", re.A)
_PARAMETER = re.compile(rf"([?&](?:token|email|phone|name|user|auth|session|password)=){SPACE.replace('[', '[^&#', 1)}*+", re.I | re.A)
_CONTROL, _SPACES = re.compile("[\x00-\x1f\x7f-\x9f]"), re.compile(f"{SPACE}+")


def _runs(rule: tuple[re.Pattern, re.Pattern], text: str) -> str:
    """Puts the mark for all matches: one goes on where the last one ended, or begins at a run's first limit."""
    out, at = [], 0
    while m := rule[0].match(text, at) or rule[1].search(text, at):
        out += (text[at : m.start()], m[1] if m.re.groups else "", REDACTED)
        at = m.end()
    return "".join([*out, text[at:]]) if out else text


def redact(text: str) -> str:
    if "@" in text:
        text = _runs(_EMAILS, text)
    text = _BEARER.sub(f"Bearer {REDACTED}", text)
    if "." in text:
        text = _runs(_THREE_PARTS, text)
    text = _DIGITS.sub(REDACTED, text)
    return _PARAMETER.sub(rf"\1{REDACTED}", text) if "=" in text else text


def trim(text: str) -> str:
    return text.strip(BLANKS)


def single_line(text: str | None, most: int) -> str:
    return redact(_SPACES.sub(" ", _CONTROL.sub(" ", text or "")).strip(" "))[:most]


def multi_line(text: str | None, most: int) -> str:
    lines = redact(re.sub("\r\n?", "\n", text or "")).split("\n")
    return "\n".join(x for x in map(trim, lines) if x)[:most]


def string_hash(text: str) -> int:
    h = SEED
    raw = text.encode("utf-16-be", "surrogatepass")
    for a, b in zip(raw[::2], raw[1::2], strict=True):
        h = (h * FACTOR & 0xFFFFFFFF) ^ (a << 8 | b)
    return h
