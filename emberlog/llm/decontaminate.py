"""Benchmark decontamination by template canonicalisation.

Words are lower-cased runs of letters and digits. Numbers, names (capitals inside a sentence) and units
(after a number) become typed placeholders; neighbouring placeholders of a type are one.
Every text is read twice, with names as placeholders and as words, so that texts in title case match too. Windows
of ``W`` template tokens, of which half at least are words, are hashed and joined
with the windows of the benchmark. Along one alignment of a document with an item the
fillers of the placeholders must agree: an item's value always with the same value of the
document within a run of windows, so that a clash parts an alignment and doesn't void it. Two values of an item may become
one, as in "3 red and 4 blue" asked with 5 and 5. A placeholder at the edge of a window
that holds more words on one side is left out: there, a neighbour outside the copy was merged with it ("Q12: 5 apples").
That also catches questions with other numbers or names. A document is contaminated if an
alignment has a run of two consistent windows, or one where the item has only one.

An item of fewer than ``W`` tokens, three at least, is one window. An item that has fewer than two windows with names as words
(it is short, or holds mostly numbers and units) is also looked for as a whole: all its words in a row, numbers and
names as they are. Only an item without any letter or digit is never found. The windows of the
benchmark are broadcast only if they are ``MOST`` rows and ``MOST_BYTES`` bytes or fewer. Otherwise the hashes of all windows of the
documents take part in a shuffled join, and only those that are found return to their documents for the fillers.

Nulls: null texts are empty and clean; items without text or id are left out. Null ids come last; rows
equal in id and text are one document. Without documents there are no rows; without items all are clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, mix, order_id, pieces_of, row_key, stored, texts, tidied, without
from .words import lower_ascii, powers_up_to, words

W, LEAST_WORDS = 8, 3
MOST, MOST_BYTES = 1 << 18, 64 << 20
#: bytes of text taken at once; a worker's arrays of numbers take some 80 times as much
SLICE = 1 << 19
NUMBER, NAME, UNIT = 1, 2, 3
# fixed values: units and number words
UNITS = "mm cm m km kg g mg lb lbs oz ft feet foot inch inches mile miles meter meters metre metres liter liters litre litres ml l gallon gallons hour hours hr hrs minute minutes min second seconds sec day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees mph kmh kw kwh mb gb tb hz khz mhz ghz kelvin celsius fahrenheit pound pounds ton tons"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:\n"]] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_LOWER = lower_ascii()


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of Latin-1 letters."""
    low = _LOWER[data]
    if len(data) > 1:
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[wide] += 0x20
    return low


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.sort(words(data, np.array([0, len(data)]), _LETTERS, _fold(data)).hash)


_UNITS, _NUMBERS = _hashes(UNITS), _hashes(NUMBERS)
_PLACE = mix(np.arange(7001, 7005, dtype=np.uint64))


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Is a value among the sorted ones? A table of 2**16 first bits settles most."""
    if not len(known):
        return np.zeros(len(values), bool)
    table = np.zeros(1 << 16, bool)
    table[(known >> np.uint64(48)).astype(np.int64)] = True
    out = table[(values >> np.uint64(48)).astype(np.int64)]
    at = np.flatnonzero(out)
    v = values[at]
    out[at] = known[np.minimum(np.searchsorted(known, v), len(known) - 1)] == v
    return out


def template(data: np.ndarray, at: np.ndarray, names: bool = True):
    """doc, hash, kind (0: a word), start and end of the template tokens of texts end to end."""
    low = _fold(data)
    w = words(data, at, _LETTERS, low)
    n = len(w.hash)
    kind = np.zeros(n, np.int8)
    if n:
        near = np.r_[False, w.doc[1:] == w.doc[:-1]]
        digits = np.r_[0, np.cumsum(_DIGIT[data])]
        ends = np.r_[0, np.cumsum(_ENDS[data])]
        number = (digits[w.end] > digits[w.start]) | _in(w.hash, _NUMBERS)
        first, second = data[w.start], data[np.minimum(w.start + 1, len(data) - 1)]
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        before = np.r_[0, w.end[:-1]]
        if names:
            small = np.r_[0, np.cumsum(_SMALL[data])]
            kind[capital & near & (ends[w.start] == ends[before]) & (small[w.end] > small[w.start])] = NAME
        kind[number] = NUMBER
        kind[_in(w.hash, _UNITS) & near & np.r_[False, number[:-1]] & ~number] = UNIT
        same = near & (kind > 0) & np.r_[False, kind[1:] == kind[:-1]]
        lead = np.flatnonzero(~same)
        last = np.r_[lead[1:], n] - 1
        return w.doc[lead], np.where(kind[lead] > 0, _PLACE[kind[lead]], w.hash[lead]), kind[lead], w.start[lead], w.end[last]
    return w.doc, w.hash, kind, w.start, w.end


def windows(doc: np.ndarray, h: np.ndarray, kind: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of the windows of ``size`` tokens that lie in one text and hold enough words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    plain = np.r_[0, np.cumsum(kind == 0)]
    at = np.flatnonzero((doc[:n] == doc[size - 1 :]) & (2 * (plain[size:] - plain[:n]) >= size))
    rolled = np.full(len(at), size, np.uint64)
    for k in range(size):
        rolled = mix(rolled) + h[at + k]
    return at, mix(rolled)


def _edges(kind, a: int, size: int) -> list[bool]:
    """For every filler: does it stand at an edge of the window?"""
    return [k in (a, a + size - 1) for k in range(a, a + size) if kind[k]]


def whole(h: np.ndarray) -> np.ndarray:
    """Hash of a stretch of words, given by their hashes: as ``stretches`` has it."""
    return stretches(np.zeros(len(h), np.int64), h, len(h))[1]


def stretches(doc: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all stretches of ``size`` words that lie in one text, at a cost that doesn't grow with size."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = powers_up_to(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * power[: len(h)], out=sums[1:])
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return at, mix((sums[at + size] - sums[at]) * inverse[at] + np.uint64(size)) ^ _PLACE[0]


def _fillers(data: bytes, kind, start, end, a: int, size: int) -> list[str]:
    return [f"{kind[k]}:{' '.join(data[start[k] : end[k]].decode(errors='replace').lower().split())}" for k in range(a, a + size) if kind[k]]


ITEM = "h long, names boolean, item_id long, item_pos int, n_windows int, size int, item_slots array<string>, edges array<boolean>"
HIT = "h long, names boolean, id long, uid long, pos int, size int, slots array<string>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


ITEM_SCHEMA = pa.schema([("h", pa.int64()), ("names", pa.bool_()), ("item_id", pa.int64()), ("item_pos", pa.int32()), ("n_windows", pa.int32()), ("size", pa.int32()), ("item_slots", pa.list_(pa.string())), ("edges", pa.list_(pa.bool_()))])
HIT_SCHEMA = pa.schema([("h", pa.int64()), ("names", pa.bool_()), ("id", pa.int64()), ("uid", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("slots", pa.list_(pa.string()))])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            at = np.zeros(0, np.int64)
            for names in (True, False):
                doc, h, kind, start, end = template(data, np.array([0, len(data)]), names)
                size = min(W, len(h))
                if size >= LEAST_WORDS:
                    at, hashes = windows(doc, h, kind, size)
                    rows += [(x, names, item, a, len(at), size, _fillers(raw, kind, start, end, a, size), _edges(kind, a, size)) for a, x in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True)]
            # at: the windows with names as words
            own = words(data, np.array([0, len(data)]), _LETTERS, _fold(data)).hash
            if len(at) < 2 and len(own):
                rows.append((int(whole(own).view(np.int64)[0]), False, item, 0, 1, -len(own), [], []))
        yield _batch(rows, ITEM_SCHEMA)


def _found(data: np.ndarray, at: np.ndarray, names: bool, sizes: list[int]):
    """(size, doc, first token, hash, position in the document) of the windows of every size, and what fillers need. Sizes below 0 are of whole items."""
    if any(s < 0 for s in sizes) and not names:
        w = words(data, at, _LETTERS, _fold(data))
        first = np.searchsorted(w.doc, np.arange(len(at)))
        for size in (s for s in sizes if s < 0):
            a, hashes = stretches(w.doc, w.hash, -size)
            # one hit a document and hash will do
            d = w.doc[a]
            _, once = np.unique(np.stack([d.astype(np.uint64), hashes], 1), axis=0, return_index=True)
            yield size, d[once], a[once], hashes[once], (a - first[d])[once], None
    doc, h, kind, start, end = template(data, at, names)
    first = np.searchsorted(doc, np.arange(len(at)))
    for size in (s for s in sizes if s > 0):
        a, hashes = windows(doc, h, kind, size)
        yield size, doc[a], a, hashes, a - first[doc[a]], (kind, start, end)


def _hits(known: np.ndarray, sizes: list[int]):
    """The windows of known hashes, with their fillers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, SLICE):
                data, at = encoded(part.column(2))
                ids, uids = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows, raw = [], None
                for names in (True, False):
                    for size, doc, a, hashes, pos, more in _found(data, at, names, sizes):
                        hit = np.flatnonzero(_in(hashes, known))
                        if len(hit):
                            raw = raw or data.tobytes()
                        for d, k, x, p in zip(doc[hit].tolist(), a[hit].tolist(), hashes[hit].view(np.int64).tolist(), pos[hit].tolist(), strict=True):
                            rows.append((x, names, ids[d], uids[d], p, size, _fillers(raw, *more, k, size) if more else []))
                yield _batch(rows, HIT_SCHEMA)

    return run


PLACE = "h long, names boolean, id long, uid long, size int"


def _places(sizes: list[int]):
    """The distinct hashes of every document's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, SLICE):
                data, at = encoded(part.column(2))
                ids, uids = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                for names in (True, False):
                    for size, doc, _, hashes, _, _ in _found(data, at, names, sizes):
                        _, once = np.unique(np.stack([doc.astype(np.uint64), hashes], 1), axis=0, return_index=True)
                        n, d = len(once), doc[once]
                        yield pa.RecordBatch.from_arrays([pa.array(hashes[once].view(np.int64)), pa.array(np.full(n, names)), pa.array(ids[d]), pa.array(uids[d]), pa.array(np.full(n, size, np.int32))], names=["h", "names", "id", "uid", "size"])

    return run


def _again(sizes: list[int]):
    """As _hits(), with the known hashes of each document in its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                known = np.sort(np.array(batch.column(3)[k].as_py(), np.int64).view(np.uint64))
                yield from _hits(known, sizes)([batch.slice(k, 1)])

    return run


def longest_run(item: list[list[int]], own: list[list[int]]) -> int:
    """Of windows in order, given by the item's and the document's fillers: the most in a row in which no value of the item has two of the document."""
    best = first = 0
    held: dict[int, list[int]] = {}  # of a value: its counterpart, and the last window that has it
    for k, (a, b) in enumerate(zip(item, own, strict=True)):
        now: dict[int, int] = {}
        if any(now.setdefault(x, y) != y for x, y in zip(a, b, strict=True)):
            first = k + 1
            continue
        for x, y in now.items():
            if x in held and held[x][0] != y:
                first = max(first, held[x][1] + 1)
        held |= {x: [y, k] for x, y in now.items()}
        best = max(best, k + 1 - first)
    return best


RUN_SCHEMA = pa.schema([("id", pa.int64()), ("uid", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int32())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256).to_pylist()
            found = [(r["id"], r["uid"], r["item_id"], longest_run(r["a"], r["b"])) for r in rows]
            yield _batch([f for f, r in zip(found, rows, strict=True) if f[3] >= min(2, r["most"])], RUN_SCHEMA)


def matches(docs: DataFrame, benchmark: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """id, uid, item_id and n_windows (of the longest consistent alignment). docs: id, uid, text."""
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    items = stored(wanted.mapInArrow(_items, ITEM), "benchmark-windows")
    size_of = F.lit(64) + F.aggregate("item_slots", F.lit(0), lambda n, x: n + F.octet_length(x) + 32)
    facts = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(size_of), F.lit(0)).alias("bytes"), F.collect_set("size").alias("sizes")).first()
    small, sizes = facts.n <= most and facts.bytes <= most_bytes, sorted(facts.sizes)
    own = docs.select("id", "uid", "text")
    if small:
        # hashes and windows of the benchmark: their rows and bytes were counted above
        known = np.sort(np.array([r.h for r in items.select("h").distinct().collect()], np.int64).view(np.uint64))
        hits, items = own.mapInArrow(tidied(_hits(known, sizes)), HIT), F.broadcast(items)
    else:
        places = own.mapInArrow(tidied(_places(sizes)), PLACE).join(items.select("h", "names", "size").distinct(), ["h", "names", "size"], "left_semi")
        back = places.groupBy("id", "uid").agg(F.collect_set("h").alias("known"))
        hits = own.dropDuplicates(["id", "uid"]).join(back, ["id", "uid"]).select("id", "uid", "text", "known").mapInArrow(tidied(_again(sizes)), HIT)
    joined = hits.join(items, ["h", "names", "size"])
    count = lambda x: F.size(F.split(x, " "))
    pairs = F.filter(F.arrays_zip("item_slots", "slots", "edges"), lambda x: ~x.edges | (count(x.item_slots) == count(x.slots)))
    pairs = F.transform(pairs, lambda x: F.struct(F.xxhash64(x.item_slots).alias("a"), F.xxhash64(x.slots).alias("b")))
    alignments = joined.groupBy("id", "uid", "item_id", "names", "size", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.min("n_windows").alias("most"), F.sort_array(F.collect_set(F.struct("item_pos", F.array_distinct(pairs).alias("pairs")))).alias("found")
    )
    side = lambda c: F.transform("found", lambda w: F.transform(w.pairs, lambda x: x[c])).alias(c)
    runs = alignments.where(F.size("found") >= F.least(F.lit(2), F.col("most"))).select("id", "uid", "item_id", "most", side("a"), side("b")).mapInArrow(tidied(_runs), "id long, uid long, item_id long, n_windows int")
    return runs.groupBy("id", "uid", "item_id").agg(F.max("n_windows").alias("n_windows"))


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, contaminated, n_items, n_windows and item_ids (ascending) of every document."""
    own = texts(docs).select(order_id().alias("id"), row_key().alias("uid"), "doc_id", "text")
    found = matches(own, benchmark, most).groupBy("id", "uid").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sum("n_windows").alias("n_windows"))
    out = own.drop("text").join(found, ["id", "uid"], "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(F.coalesce("item_ids", none)).alias("n_items"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("item_ids", none).alias("item_ids"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, most: int = MOST) -> DataFrame:
    """docs without the contaminated documents."""
    own = texts(docs).select(order_id().alias("id"), row_key().alias("uid"), "text")
    found = stored(matches(own, benchmark, most).select("id", "uid").distinct(), "leaks")
    return without(docs, found)
