"""JSON contexts: flat ones and trees as SQL expressions, and trees by one Arrow UDF, which costs less."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import REDACTED, ErrorReporting
from . import model, text

CLEANED = "context string, identifiers array<struct<key: string, value: string>>"

def _object(raw: str | None) -> dict:
    try:
        value = json.loads(raw) if raw else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


_PARTS = '"(?:[^"\\\\]|\\\\.)*+"|[-+.0-9Ee]++|[^-+.0-9E"]++|.'
_ODD_NUMBER = "[0-9]\\.0(?![0-9])|[0-9]E"


def plain_numbers(json_text: Column) -> Column:
    """JSON with numbers as JavaScript prints them: 100.0 is 100, 1.0E7 is 10000000, 1.0E21 is 1e+21. Texts stay. Numbers of more digits than a double has stay too."""

    def number(x: Column) -> Column:
        power = F.regexp_extract(x, "E(-?[0-9]+)$", 1)
        e = F.when(power != "", power.cast("int"))
        short = F.regexp_replace(x, "\\.0(?=E|$)", "")
        placed = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,16)").cast("string"), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
        return F.when(e.isNull(), short).when(e.between(-6, 20), placed).when(e > 0, F.regexp_replace(short, "E", "e+")).otherwise(F.regexp_replace(short, "E", "e"))

    def plain(x: Column) -> Column:
        return F.when(x.rlike("^-?[0-9]"), number(x)).otherwise(x)

    return F.when(json_text.rlike(_ODD_NUMBER), F.array_join(F.transform(F.regexp_extract_all(json_text, F.lit(_PARTS), F.lit(0)), plain), "")).otherwise(json_text)


def merge_json(default: Column, event: Column) -> Column:
    """Two JSON objects in one, keys in order of first mention; the event's values win. What isn't an object is {}."""
    empty = F.from_json(F.lit("{}"), "map<string,variant>")
    entries = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), empty)

    def merged(a: Column, b: Column) -> Column:
        won = F.transform(F.map_entries(a), lambda e: F.struct(e["key"].alias("key"), F.when(F.map_contains_key(b, e["key"]), F.element_at(b, e["key"])).otherwise(e["value"]).alias("value")))
        return plain_numbers(F.to_json(F.map_concat(F.map_from_entries(won), F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))))

    return text.let(entries(default), lambda a: text.let(entries(event), lambda b: merged(a, b)))


def _number(value) -> str:
    """A number as JavaScript prints it, for common sizes."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return repr(value)


class Cleaner:
    """Walks a tree: redacts by key, bounds depth and breadth, sanitizes texts, gathers what was redacted."""

    def __init__(self, cfg: ErrorReporting):
        self.keys, self.depth, self.breadth, self.longest = cfg.redact_keys, cfg.max_context_depth, cfg.max_context_breadth, cfg.max_message_length

    def sensitive(self, key: str) -> bool:
        low = model.trim(key).lower()
        return bool(low) and any(k in low for k in self.keys)

    def identifier(self, value) -> str:
        if value is None:
            return "null"
        if isinstance(value, bool):
            shown = "true" if value else "false"
        elif isinstance(value, (int, float)):
            shown = _number(value)
        else:
            shown = value if isinstance(value, str) else dumps(value)
        return model.single_line(shown, self.longest) or "empty"

    def clean(self, context) -> tuple[dict, list[tuple[str, str]]]:
        if not isinstance(context, dict):
            return {}, []
        found: list[tuple[str, str]] = []
        return self._entries(context, 0, "", {id(context)}, found), found

    def _entries(self, tree: dict, depth: int, path: str, seen: set[int], found: list) -> dict:
        out = {}
        for key, value in list(tree.items())[: self.breadth]:
            here = f"{path}.{key}" if path else key
            if self.sensitive(key):
                out[key] = REDACTED
                if model.trim(here):
                    found.append((model.single_line(here, 160), self.identifier(value)))
            else:
                out[key] = self._value(value, depth + 1, here, seen, found)
        return out

    def _value(self, value, depth: int, path: str, seen: set[int], found: list):
        if value is None or isinstance(value, bool):
            return value
        if isinstance(value, (int, float)):
            return value if math.isfinite(value) else None
        if isinstance(value, str):
            return model.single_line(value, self.longest)
        if isinstance(value, (list, dict)):
            if id(value) in seen:
                return "[circular]"
            seen.add(id(value))
            if depth >= self.depth:
                return "[truncated]"
            if isinstance(value, dict):
                return self._entries(value, depth, path, seen, found)
            return [self._value(x, depth + 1, f"{path}[]", seen, found) for x in value[: self.breadth]]
        if hasattr(value, "isoformat"):
            return value.isoformat()
        return model.single_line(str(value), self.longest)


def _quoted(value: Column) -> Column:
    """A text as JSON."""
    return text.let(F.to_json(F.array(value)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def _children(node: Column, opening: Column, breadth: int) -> Column:
    """(key, raw, shown) of the first entries of an object, or elements of an array, given as JSON: as text, and as JSON by which types are told.

    Both are read from the node's own text, since a variant would put the keys of inner objects in another order.
    """

    def of(kind: str, entries: Callable[[Column], Column], key: Callable[[Column], Column], raw: Callable[[Column], Column]) -> Column:
        texts, values = (F.slice(entries(F.from_json(node, kind.format(t))), 1, breadth) for t in ("string", "variant"))
        shown = F.transform(values, lambda e: F.coalesce(F.to_json(raw(e)), F.lit("null")))
        return F.zip_with(texts, shown, lambda e, x: F.struct(key(e).alias("key"), raw(e).alias("raw"), x.alias("shown")))

    none = F.lit(None).cast("string")
    objects = of("map<string,{}>", F.map_entries, lambda e: e["key"], lambda e: e["value"])
    arrays = of("array<{}>", lambda x: x, lambda e: none, lambda e: e)
    return F.when(opening == "{", objects).when(opening == "[", arrays)


_PAIR = "\\\\u[dD][89abAB][0-9a-fA-F]{2}\\\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def _unescaped(json_text: Column) -> Column:
    """JSON whose characters beyond the first plane stand for themselves, not as two escapes."""
    parts = F.regexp_extract_all(json_text, F.lit(f"{_PAIR}|\\\\.|[^\\\\]++"), F.lit(0))
    plain = lambda x: F.when(x.rlike(f"^{_PAIR}$"), F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>")[0]).otherwise(x)
    return F.when(json_text.contains("\\uD"), F.array_join(F.transform(parts, plain), "")).otherwise(json_text)


_FOUND = "array<struct<key:string,value:string>>"


def _walk(node: Column, opening: Column, path: Column, depth: int, cfg: ErrorReporting) -> Column:
    """struct(context, identifiers) of an object's or array's JSON, one level of expressions for each level of depth."""
    nothing = F.array().cast(_FOUND)
    plain = lambda json_text: F.struct(json_text.alias("context"), nothing.alias("identifiers"))

    def value(raw: Column, shown: Column, kind: Column, here: Column) -> Column:
        inner = _walk(raw, kind, here, depth + 1, cfg) if depth + 1 < cfg.max_context_depth else plain(F.lit('"[truncated]"'))
        number = F.when(shown.rlike("^-?[0-9]"), plain_numbers(shown)).otherwise("null")
        leaf = F.when(kind == '"', _quoted(text.single_line(raw, cfg.max_message_length))).when(kind.isin("t", "f", "n"), shown).otherwise(number)
        return F.when(kind.isin("{", "["), inner).otherwise(plain(leaf))

    def identifier(raw: Column, shown: Column, kind: Column) -> Column:
        given = F.when(kind == '"', raw).when(kind.isin("{", "["), _unescaped(plain_numbers(raw))).when(kind.isin("t", "f", "n"), shown).otherwise(plain_numbers(shown))
        return F.when(shown == "null", "null").otherwise(text.or_else(text.single_line(given, cfg.max_message_length), "empty"))

    def child(c: Column) -> Column:
        here = F.when(opening == "[", F.concat(path, F.lit("[]"))).when(path == "", c["key"]).otherwise(F.concat(path, F.lit("."), c["key"]))
        # bound once, since the next level names both many times
        return text.let(F.struct(F.substring(c["shown"], 1, 1).alias("kind"), here.alias("here")), lambda bound: placed(c, bound["kind"], bound["here"]))

    def placed(c: Column, kind: Column, here: Column) -> Column:

        def told(x: Column) -> Column:
            found = F.array(F.struct(text.single_line(here, 160).alias("key"), identifier(c["raw"], c["shown"], kind).alias("value")))
            secret = F.coalesce(text.is_sensitive(c["key"], cfg.redact_keys), F.lit(False))
            return F.when(secret, F.struct(F.lit(json.dumps(REDACTED)).alias("context"), found.alias("identifiers"))).otherwise(x)

        done = told(value(c["raw"], c["shown"], kind, here))
        name = F.when(c["key"].isNotNull(), F.concat(_quoted(c["key"]), F.lit(":"))).otherwise("")
        return text.let(done, lambda d: F.struct(F.concat(name, d["context"]).alias("context"), d["identifiers"].alias("identifiers")))

    def joined(parts: Column) -> Column:
        inside = F.array_join(F.transform(parts, lambda p: p["context"]), ",")
        whole = F.concat(opening, inside, F.when(opening == "{", "}").otherwise("]"))
        return F.struct(whole.alias("context"), F.flatten(F.transform(parts, lambda p: p["identifiers"])).alias("identifiers"))

    return text.let(F.transform(_children(node, opening, cfg.max_context_breadth), child), joined)


def clean_tree(context: Column, cfg: ErrorReporting) -> Column:
    """struct(context, identifiers) of a JSON object; {} for what isn't one. An Arrow UDF: a third of clean_tree_native()'s time."""

    @F.pandas_udf(CLEANED)
    def cleaned(raw: pd.Series) -> pd.DataFrame:
        cleaner = Cleaner(cfg)
        rows = [cleaner.clean(_object(x)) for x in raw]
        return pd.DataFrame({"context": [dumps(c) for c, _ in rows], "identifiers": [[{"key": k, "value": v} for k, v in f] for _, f in rows]})

    return cleaned(context)


def clean_tree_native(context: Column, cfg: ErrorReporting) -> Column:
    """The same in SQL expressions, unrolled to the depth that is kept (deeper parts are cut anyway), where no Python worker is wanted."""
    nothing = F.struct(F.lit("{}").alias("context"), F.array().cast(_FOUND).alias("identifiers"))
    there = F.try_parse_json(context).isNotNull() & F.ltrim(context).startswith("{")
    return F.when(there, _walk(context, F.lit("{"), F.lit(""), 0, cfg)).otherwise(nothing)


def flat_entries(context: Column, breadth: int) -> Column:
    """The first entries of a flat JSON object, in order, with values as text."""
    return F.slice(F.coalesce(F.map_entries(F.from_json(context, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>")), 1, breadth)


def clean_flat(context: Column, cfg: ErrorReporting) -> Column:
    """Map of a flat object's first entries: redacted by key, else sanitized. Numbers become text."""
    entries = flat_entries(context, cfg.max_context_breadth)
    clean = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.when(text.is_sensitive(e["key"], cfg.redact_keys), F.lit(REDACTED)).when(e["value"].isNull(), F.lit(None)).otherwise(text.single_line(e["value"], cfg.max_message_length)).alias("value")))
    return F.map_from_entries(clean)


def flat_identifiers(context: Column, cfg: ErrorReporting) -> Column:
    """(key, value) of a flat object's redacted entries, at most as many as the breadth."""
    redacted = F.filter(flat_entries(context, cfg.max_context_breadth), lambda e: text.is_sensitive(e["key"], cfg.redact_keys))
    value = lambda v: F.when(v.isNull(), "null").otherwise(text.or_else(text.single_line(v, cfg.max_message_length), "empty"))
    return F.transform(redacted, lambda e: F.struct(text.single_line(e["key"], 160).alias("key"), value(e["value"]).alias("value")))
