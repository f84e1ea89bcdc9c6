"""Redaction and sanitizing of text as column expressions, without UDFs.

Lengths are counted in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import QUEUE_PREFIX, REDACTED

# fixed values: patterns. Java's \b and \s differ from the ASCII word limit and the
# white space that are meant, so both are spelled out.
WORD = "[A-Za-z0-9_]"
LIMIT = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
NO_SPACE = SPACE.replace("[", "[^&#", 1)


def _from(run: str, signs: str) -> str:
    """Start of a match that begins with a whole run of ``run``: at the run's first limit, which is its first letter, digit or underscore.

    All limits of a run lead to the same end, so only the first one is tried and a run is read once. ``signs``, what
    may stand before it in the run, is group 1. A match that ends inside a run leaves its rest to the next one (\\G).
    """
    return f"(?:\\G{LIMIT}|(?<!{run})([{signs}]*+)){run}++"


EMAIL = f"(?i){_from('[A-Z0-9._%+-]', '.%+-')}@[A-Z0-9.-]+\\.[A-Z]{{2,}}{LIMIT}"
BEARER = f"(?i){LIMIT}Bearer{SPACE}++[A-Z0-9._-]+{LIMIT}"
THREE_PARTS = f"{_from('[A-Za-z0-9_-]', '-')}\\.[A-Za-z0-9_-]++\\.[A-Za-z0-9_-]+{LIMIT}"
DIGITS = f"{LIMIT}[0-9]{{9,}}+{LIMIT}"
PARAMETER = f"(?i)([?&](?:token|email|phone|name|user|auth|session|password)=){NO_SPACE}*+"

#: what a text must hold for a pattern to match, at less cost; the pattern; what is put in its place
RULES: tuple[tuple[Callable[[Column], Column], str, str], ...] = (
    (lambda t: F.contains(t, F.lit("@")), EMAIL, f"$1{REDACTED}"),
    (lambda t: t.rlike("[Bb][Ee][Aa][Rr][Ee][Rr]"), BEARER, f"Bearer {REDACTED}"),
    (lambda t: F.contains(t, F.lit(".")) & t.rlike("\\.[A-Za-z0-9_-]++\\.[A-Za-z0-9_-]"), THREE_PARTS, f"$1{REDACTED}"),
    (lambda t: t.rlike("[0-9]{9}"), DIGITS, REDACTED),
    (lambda t: F.contains(t, F.lit("=")) & (F.contains(t, F.lit("?")) | F.contains(t, F.lit("&"))), PARAMETER, f"$1{REDACTED}"),
)


def redact(text: Column) -> Column:
    """E-mail addresses, bearer tokens, three dotted parts, long digit runs and telling query parameters, in this order."""
    for rule in RULES:
        text = let(text, partial(_put, rule))
    return text


def _put(rule: tuple[Callable[[Column], Column], str, str], text: Column) -> Column:
    gate, pattern, put = rule
    return F.when(gate(text), F.regexp_replace(text, F.lit(pattern), F.lit(put))).otherwise(text)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def single_line(text: Column, most: int) -> Column:
    """Control characters and runs of white space become one space; redacted, then cut. Null gives ''."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit("\\p{Cc}"), F.lit(" "))
    flat = F.trim(F.regexp_replace(flat, F.lit(f"{SPACE}++"), F.lit(" ")))
    return F.substring(redact(flat), 1, most)


def multi_line(text: Column, most: int) -> Column:
    """Redacted as a whole; lines are trimmed, blank ones dropped; cut. Null gives ''."""
    lines = F.split(redact(F.regexp_replace(F.coalesce(text, F.lit("")), F.lit("\\r\\n?"), F.lit("\n"))), "\n")
    kept = F.filter(F.transform(lines, trim), lambda x: F.length(x) > 0)
    return F.substring(F.array_join(kept, "\n"), 1, most)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def or_else(text: Column, default: str | Column) -> Column:
    """default for ''."""
    return let(text, lambda t: F.when(F.length(t) > 0, t).otherwise(default if isinstance(default, Column) else F.lit(default)))


def tags(values: Column, most: int, longest: int) -> Column:
    """Sanitized, without blanks and repeats, the first ones; null if none are left.

    Most lists have enough in their first few different values, so the others are sanitized only where these don't do.
    """
    few = 4 * most

    def clean(some: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(some, lambda x: single_line(x, longest)), lambda x: F.length(x) > 0))

    def chosen(given: Column) -> Column:
        def enough(first: Column) -> Column:
            return F.when((F.size(first) >= most) | (F.size(given) <= few), first).otherwise(clean(given))

        return let(clean(F.slice(given, 1, few)), enough)

    return let(F.slice(let(F.array_distinct(values), chosen), 1, most), lambda kept: F.when(F.size(kept) > 0, kept))


def storage_segment(source: Column) -> Column:
    return or_else(F.regexp_replace(F.lower(trim(source)), F.lit("[^a-z0-9._-]+"), F.lit("-")), "unknown-source")


def storage_key(source: Column, channel: Column) -> Column:
    return F.concat_ws(".", F.lit(QUEUE_PREFIX), channel, storage_segment(source))


def is_sensitive(key: Column, keys: tuple[str, ...]) -> Column:
    """Does the key contain one of the redact keys?"""
    # one pass over the keys; the key itself is lower-cased once. Redact keys have no white space around them, so none has to go first.
    return let(F.lower(key), lambda low: reduce(or_, [F.contains(low, F.lit(k)) for k in keys], F.lit(False)))


def secure_endpoint(url: Column) -> Column:
    """https, paths, and http to this host. ``//host`` is refused; ``[::1]`` is this host."""
    u = trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    # the text after the scheme's slashes up to the path, without user and port
    place = F.regexp_extract(u, "^[A-Za-z]+:[/\\\\]*([^/\\\\?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(place, "^.*@", ""), ":[0-9]*$", ""))
    parsable = (F.length(host) > 0) & ~host.rlike("[\\s<>^|%]") & ~F.regexp_replace(place, "^\\[[^\\]]*\\]", "").rlike(":[^0-9]")
    return (
        F.when(F.length(u) == 0, False)
        .when(u.startswith("//"), False)
        .when(u.startswith("/"), True)
        .when(F.length(scheme) == 0, True)  # relative to a secure page
        .when(scheme == "https", parsable)
        .when(scheme == "http", parsable & host.isin("localhost", "127.0.0.1", "[::1]"))
        .otherwise(False)
    )
