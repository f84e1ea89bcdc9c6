"""Removal of every 50-byte string that also starts in a document with a smaller doc_id.

Documents come in batches of ascending doc_ids (``BATCHES``; their limits are approximate quantiles). A batch's suffixes are sorted
into an array, the array is merge-scanned against the levels of those before it for matches of ``LENGTH`` bytes,
and then it joins them as a level; levels of like size are merged, so that sizes grow geometrically. What a
batch loses is thus found in itself and in the levels of smaller doc_ids alone.

A suffix array of all positions isn't needed: a string of ``LENGTH`` bytes holds ``LENGTH - GRAM + 1`` grams of ``GRAM`` bytes, and the
positions whose gram has the smallest hash of such a string (anchors, about one in 14) are the
same wherever the string stands. So only suffixes that begin at anchors are sorted, each with the
bytes before it that a string around the anchor can reach.

1. A batch is dealt to blocks of about ``block_bytes``. A block sends the hashes of its anchors' grams; those of two documents
   or more return to it.
2. For these anchors the block sends its sorted suffixes with the smallest doc_id of each, by buckets of grams. A bucket has a family
   of levels: batches are scanned in turn. Suffixes of the array and of a level that share their gram are a range of
   both; the strings around them are compared by 64-bit hashes.
3. What a block's suffixes found returns to it, and the covered bytes are removed.

A gram that is everywhere arrives once per block and surroundings, not once per occurrence. A gram of more than
``HOT`` blocks is parted by its neighbours: strings that begin close to it go to the bucket of the gram and the bytes after it, the
others to that of the gram and the bytes before. Every string is still judged in one place. All three
passes read one shuffle of the texts.

Overlaps count, strings are judged on the input, and matches never cross documents. Null
texts are empty; a null id is larger than every other; rows with one id are never smaller than each other. Texts
of fewer than 50 bytes keep everything. An empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, mix, order_id, row_key, shuffle_partitions, texts

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # grams in a string
LEFT = SPAN - 1
NEAR = SPAN // 2  # strings around a frequent gram that begin at most so far before it are parted from the others
HOT = 64
BATCHES = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(501, 757, dtype=np.uint64))
KEY = np.dtype(f"S{LENGTH + LEFT + 2}")  # suffix, bytes before it, their lengths


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over every n neighbours."""
    width = 1
    while 2 * width <= n:
        x = f(x[:-width], x[width:])
        width *= 2
    return f(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of every position with GRAM bytes; by doubling, so that no table grows with the text."""
    h, width = _BYTE[data], 1
    parts = []
    left = GRAM
    at = 0
    while left:
        if left & 1:
            parts.append((at, h, width))
            at += width
        left >>= 1
        if left:
            power = np.uint64(pow(int(_BASE), width, 1 << 64))
            h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
            width *= 2
    n = max(0, len(data) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for start, part, _ in parts:
        out = mix(out) + part[start : start + n] if start else part[:n].copy()
    return mix(out)


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of texts end to end (limits ``at``)."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    least = _slide(h, SPAN, np.minimum)  # of the string at each position
    n = len(least)
    # strings that cross the end of a text don't count
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, np.maximum(at[1:] - LENGTH + 1, at[:-1]), 1)
    np.add.at(edge, at[1:], -1)
    least[np.cumsum(edge)[:n] > 0] = 0
    # a position is an anchor if it's the least of some string around it
    most = _slide(np.concatenate([np.zeros(LEFT, np.uint64), least, np.zeros(LEFT, np.uint64)]), SPAN, np.maximum)
    found = np.flatnonzero((most == h) & (most > 0))
    return found, h[found]


def contexts(data: np.ndarray, at: np.ndarray, where: np.ndarray, doc: np.ndarray, before: np.ndarray | int = LEFT, after: np.ndarray | int = LENGTH) -> np.ndarray:
    """Keys of anchors: LENGTH bytes from the anchor (``after`` at most), LEFT bytes before it (``before`` at most, nearest first), both filled with zeros, and their numbers plus 1."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    out = np.zeros((len(where), KEY.itemsize), np.uint8)
    left, right = np.minimum(where - at[doc], before), np.minimum(at[doc + 1] - where, after)
    for k in range(LENGTH):
        out[:, k] = np.where(k < right, padded[where + (LEFT + k)], 0)
    for k in range(LEFT):
        out[:, LENGTH + k] = np.where(k < left, padded[where + (LEFT - 1 - k)], 0)
    out[:, -2], out[:, -1] = left + 1, right + 1
    return out.view(KEY).ravel()


def key_hashes(keys: np.ndarray) -> np.ndarray:
    """64 bits of each key."""
    rows = keys.view(np.uint8).reshape(len(keys), KEY.itemsize)
    out = np.full(len(keys), 1, np.uint64)
    wide = np.zeros((len(keys), -(-KEY.itemsize // 8) * 8), np.uint8)
    wide[:, : KEY.itemsize] = rows
    for column in wide.view("<u8").T:
        out = mix(out * _BASE + column)
    return out


NONE = np.iinfo(np.int64).max


class Level:
    """Sorted distinct suffixes with the smallest id of each."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys, kind="stable")  # merges runs that are sorted already
        keys, ids = keys[order], ids[order]
        fresh = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
        new = np.flatnonzero(fresh)
        self.keys, self.ids = keys[new], np.minimum.reduceat(ids, new) if len(new) else ids
        self.place = np.empty(len(keys), np.int64)  # of each key that was given
        self.place[order] = np.cumsum(fresh) - 1
        rows = self.keys.view(np.uint8).reshape(len(self), KEY.itemsize)
        self.grams = np.ascontiguousarray(rows[:, :GRAM]).view(f"S{GRAM}").ravel()

    def __len__(self) -> int:
        return len(self.keys)


class Family:
    """Levels whose sizes grow geometrically."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Takes a batch in as a level."""
        self.join(Level(keys, ids))

    def join(self, level: Level) -> None:
        """Levels no larger than twice what comes above them are merged with it."""
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            low = self.levels.pop()
            level = Level(np.concatenate([low.keys, level.keys]), np.concatenate([low.ids, level.ids]))
        self.levels.append(level)

    def scan(self, new: Level) -> np.ndarray:
        """For each suffix of a batch the smallest id, in the batch and in all levels, of the SPAN strings around it (by bytes before the anchor; NONE: no such string)."""
        n = len(new)
        out = np.where(_whole(new.keys), new.ids[:, None], NONE)
        if not n:
            return out
        grams = new.grams
        heads = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        counts = np.diff(np.r_[heads, n])
        grams = grams[heads]
        shared, ranges = counts > 1, []
        for level in self.levels:
            # neither array is searched as a whole but for ranges of equal grams
            low = np.searchsorted(level.grams, grams, "left")
            high = low.copy()
            held = np.flatnonzero(level.grams[np.minimum(low, len(level) - 1)] == grams)
            high[held] = np.searchsorted(level.grams, grams[held], "right")
            shared |= high > low
            ranges.append(_each(low, high))
        some = np.flatnonzero(np.repeat(shared, counts))
        if not len(some):
            return out
        found = _Strings(new.keys[some], new.ids[some])
        for level, at in zip(self.levels, ranges, strict=True):
            if len(at):
                hashes, ids, _ = _flat(level.keys[at], level.ids[at])
                found.lower(*_smallest(hashes, ids)[:2])
        out[some] = found.table()
        return out


def _each(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0], ..., high[0] - 1, low[1], ..."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _whole(keys: np.ndarray) -> np.ndarray:
    """Which of the SPAN strings around each anchor lie within its key."""
    rows = keys.view(np.uint8).reshape(len(keys), KEY.itemsize)
    left, right = rows[:, -2].astype(np.int64) - 1, rows[:, -1].astype(np.int64) - 1
    before = np.arange(SPAN)[None, :]
    return (before <= left[:, None]) & (LENGTH - before <= right[:, None])


def _flat(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ids of all strings around the anchors, and which strings these are. Zeros within texts don't matter, since only whole strings are taken."""
    ok = _whole(keys)
    rows = keys.view(np.uint8).reshape(len(keys), KEY.itemsize)
    order = [*range(LENGTH + LEFT - 1, LENGTH - 1, -1), *range(LENGTH)]  # as in the text
    text = _BYTE[rows[:, order]]
    power = _powers(LENGTH + 1)
    # hashes of all strings around the anchor by one rolling pass over the columns
    h = np.zeros(len(keys), np.uint64)
    for k in range(LENGTH):
        h = h * _BASE + text[:, k]
    hashes = np.zeros((len(keys), SPAN), np.uint64)
    hashes[:, LEFT] = h
    for first in range(1, SPAN):
        h = (h - text[:, first - 1] * power[LENGTH - 1]) * _BASE + text[:, first + LENGTH - 1]
        hashes[:, LEFT - first] = h
    hashes += mix(np.arange(SPAN, dtype=np.uint64))[None, :]
    return mix(hashes[ok]), np.broadcast_to(ids[:, None], ok.shape)[ok], ok


def _smallest(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, the smallest id of each, and where each of the given ones stands."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    fresh = np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]
    new = np.flatnonzero(fresh)
    place = np.empty(len(hashes), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return hashes[new], np.minimum.reduceat(ids[order], new) if len(new) else ids, place


class _Strings:
    """The distinct strings around a batch's suffixes with the smallest id that is known of each."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        flat, ids, self.ok = _flat(keys, ids)
        self.hashes, self.ids, self.at = _smallest(flat, ids)

    def lower(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        if len(hashes) and len(self.hashes):
            place = np.minimum(np.searchsorted(hashes, self.hashes), len(hashes) - 1)
            self.ids = np.where(hashes[place] == self.hashes, np.minimum(self.ids, ids[place]), self.ids)

    def table(self) -> np.ndarray:
        out = np.full(self.ok.shape, NONE)
        out[self.ok] = self.ids[self.at]
        return out


GRAMS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("grams", pa.binary()), ("several", pa.binary())])
AGAIN = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("hot", pa.binary())])
BATCH = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("most", pa.binary())])
FOUND = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])
CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])


def _schema(s: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in s)


@cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(a: np.ndarray) -> bytes:
    return _zstd()[0].compress(a.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(b), kind)


_SHORT = np.uint64((1 << 48) - 1)  # with the bucket, that is a gram's hash but for a few bits; what is taken too much costs time, no result


def _named(short: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """One number for both, so that all blocks take a gram as frequent or none does."""
    return mix(short + mix(np.atleast_1d(np.asarray(bucket, np.uint64)) + np.uint64(1)))


def _short(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _split(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    if not len(bucket):
        return []
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True))


def _block(table: pa.Table):
    table = table.combine_chunks()
    data, at = encoded(table.column("text"))
    where, h = anchors(data, at)
    doc = np.searchsorted(at, where, "right") - 1
    return data, at, where, h, doc, table.column("id").to_numpy()


def _send_grams(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, _, h, doc, ids = _block(table)
        block = table.column("block")[0].as_py()
        order = np.argsort(h)
        h, who = h[order], ids[doc][order]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        grams, several = h[new], np.maximum.reduceat(who, new) != np.minimum.reduceat(who, new) if len(new) else np.zeros(0, bool)
        bucket = _bucket(grams, buckets)  # ascending, as grams are
        rows = [(b, block, _short(grams[x:y]), np.packbits(several[x:y]).tobytes()) for b, x, y in _split(bucket)]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(GRAMS)], schema=GRAMS)

    return run


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _repeated(table: pa.Table) -> pa.Table:
    blocks, buckets = table.column("block").to_pylist(), table.column("bucket").to_pylist()
    parts = [_wide(x) for x in table.column("grams").to_pylist()]
    marks = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("several").to_pylist(), parts, strict=True)]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(p[m] for p, m in zip(parts, marks, strict=True))]))
    hot = np.searchsorted(every, twice, "right") - np.searchsorted(every, twice, "left") > HOT
    del every
    rows = []
    if len(twice):
        for block, bucket, p in zip(blocks, buckets, parts, strict=True):
            place = np.minimum(np.searchsorted(twice, p), len(twice) - 1)
            hit = twice[place] == p
            if hit.any():
                rows.append((block, bucket, _short(p[hit]), np.packbits(hot[place[hit]]).tobytes()))
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(AGAIN)], schema=AGAIN)


def _wanted(table: pa.Table, again: pa.Table, buckets: int):
    """The block's anchors whose grams returned, with their keys and buckets; a frequent gram has two of each."""
    data, at, where, h, doc, ids = _block(table)
    parts = [_wide(x) for x in again.column("grams").to_pylist()]
    known = np.concatenate([np.zeros(0, "<u8"), *(_named(p, b) for p, b in zip(parts, again.column("bucket").to_pylist(), strict=True))])
    often = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(again.column("hot").to_pylist(), parts, strict=True))]).astype(bool)
    order = np.argsort(known)
    known, often = known[order], often[order]
    bucket = _bucket(h, buckets)
    named = _named(h & _SHORT, bucket)
    place = np.minimum(np.searchsorted(known, named), max(0, len(known) - 1))
    hit = known[place] == named if len(known) else np.zeros(len(h), bool)
    where, doc, bucket, often = where[hit], doc[hit], bucket[hit], often[place[hit]] if len(known) else hit[:0]
    left, right = where - at[doc], at[doc + 1] - where
    # strings with at most NEAR bytes before the anchor; those with more
    first, second = np.flatnonzero(often & (right >= LENGTH - NEAR)), np.flatnonzero(often & (left > NEAR))
    rest = np.flatnonzero(~often)
    take = np.concatenate([rest, first, second])
    before = np.repeat([LEFT, NEAR, LEFT], [len(rest), len(first), len(second)])
    after = np.repeat([LENGTH, LENGTH, LENGTH - NEAR - 1], [len(rest), len(first), len(second)])
    keys = contexts(data, at, where[take], doc[take], before, after)
    # the bytes that all strings of a part hold
    core = keys[len(rest) :].copy().view(np.uint8).reshape(-1, KEY.itemsize)
    core[: len(first), LENGTH - NEAR :] = 0
    core[len(first) :, GRAM:LENGTH] = 0
    core[len(first) :, LENGTH + NEAR + 1 :] = 0
    bucket = np.concatenate([bucket[rest], _bucket(key_hashes(core.reshape(-1).view(KEY)), buckets)])
    return data, at, where[take], doc[take], ids, keys, bucket


def _send_batch(buckets: int):
    def run(table: pa.Table, again: pa.Table) -> pa.Table:
        if not table.num_rows:
            return BATCH.empty_table()
        _, _, _, doc, ids, keys, bucket = _wanted(table, again, buckets)
        block, who = table.column("block")[0].as_py(), ids[doc]
        order = np.argsort(keys, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        keys, who, bucket = keys[order], who[order], bucket[order]
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])][: len(keys)])
        low, high = (f.reduceat(who, new) if len(new) else who for f in (np.minimum, np.maximum))
        keys, bucket = keys[new], bucket[new]
        rows = [(b, block, _pack(keys[x:y]), _pack(low[x:y]), _pack(high[x:y] - low[x:y])) for b, x, y in _split(bucket)]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(BATCH)], schema=BATCH)

    return run


def _scan(first: list[int]):
    """``first``: the first block of each batch."""

    def run(table: pa.Table) -> pa.Table:
        blocks = np.array(table.column("block").to_pylist(), np.int64)
        batch = np.searchsorted(first, blocks, "right")
        columns = [table.column(c).to_pylist() for c in ("keys", "ids", "most")]
        family, rows = Family(), []
        for b in np.unique(batch).tolist():
            own = np.flatnonzero(batch == b).tolist()
            keys, ids, span = ([_unpack(column[k], kind) for k in own] for column, kind in zip(columns, (KEY, "<i8", "<i8"), strict=True))
            level = Level(np.concatenate(keys), np.concatenate(ids))
            least = family.scan(level)
            lowest = least.min(1)
            ends = np.cumsum([0, *map(len, keys)]).tolist()
            for k, part, low, more, x, y in zip(own, keys, ids, span, ends[:-1], ends[1:], strict=True):
                at = level.place[x:y]
                useful = lowest[at] < low + more  # some document of the block loses something
                if useful.any():
                    rows.append((int(blocks[k]), key_hashes(part[useful]).tobytes(), _pack(least[at[useful]])))
            family.join(level)
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(FOUND)], schema=FOUND)

    return run


def _cut(table: pa.Table, again: pa.Table, found: pa.Table, buckets: int) -> pa.Table:
    data, at, where, doc, ids, keys, _ = _wanted(table, again, buckets)
    n = len(data)
    edge = np.zeros(n + 1, np.int64)
    if found.num_rows:
        known = np.concatenate([np.frombuffer(x, "<u8") for x in found.column("keys").to_pylist()])
        least = np.concatenate([_unpack(x, "<i8").reshape(-1, SPAN) for x in found.column("ids").to_pylist()])
        order = np.argsort(known)
        known, least = known[order], least[order]
        h = key_hashes(keys)
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[place] == h
        where, doc, place = where[hit], doc[hit], place[hit]
        row, before = np.nonzero(least[place] < ids[doc][:, None])
        start = where[row] - before
        edge += np.bincount(start, minlength=n + 1) - np.bincount(start + LENGTH, minlength=n + 1)
    gone = np.cumsum(edge)[:n] > 0
    rows = []
    for doc_id, a, b in zip(table.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        g = gone[a:b]
        turns = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
        rows.append((doc_id, b - a, turns[::2], turns[1::2], data[a:b][~g].tobytes()))
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(CUT)], schema=CUT)


def _cut_block(buckets: int):
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return CUT.empty_table()
        kind = np.array(back.column("bucket").is_null().to_pylist(), bool) if back.num_rows else np.zeros(0, bool)
        return _cut(table, back.filter(pa.array(~kind)).rename_columns(AGAIN.names), back.filter(pa.array(kind)).rename_columns(["block", "bucket", "keys", "ids"]), buckets)

    return run


def spans(docs: DataFrame, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, starts and ends (of the removed runs) and kept (the remaining bytes) of every document.

    ``block_bytes``: of the texts of a block, on average; a task needs some 50 times as much memory.
    """
    d = texts(docs).select("doc_id", order_id().alias("id"), row_key().alias("uid"), "text")
    parts = shuffle_partitions(docs.sparkSession)
    limits = d.agg(F.percentile_approx("id", [k / BATCHES for k in range(1, BATCHES)], 1000).alias("x")).first().x or []
    batch = sum((F.when(F.col("id") > x, 1).otherwise(0) for x in sorted(set(limits))), F.lit(0))
    # one row per batch
    size = {r.batch: r.n for r in d.groupBy(batch.alias("batch")).agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    n, last = sum(size.values()), max(size, default=0)
    count = [max(1, size.get(k, 0) // block_bytes, 2 * parts * size.get(k, 0) // max(1, n)) for k in range(last + 1)]
    first = np.cumsum([0, *count[:-1]]).tolist()
    buckets = max(2 * parts, 2 * n // block_bytes)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), batch + 1)
    block = (pick(first) + F.pmod(F.xxhash64("id", "uid"), pick(count))).cast("int")
    d = d.select("doc_id", "id", "text", block.alias("block"))
    grams = d.groupBy("block").applyInArrow(_send_grams(buckets), _schema(GRAMS))
    again = grams.groupBy("bucket").applyInArrow(_repeated, _schema(AGAIN))
    batches = d.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(_send_batch(buckets), _schema(BATCH))
    found = batches.groupBy("bucket").applyInArrow(_scan(first), _schema(FOUND))
    back = again.unionAll(found.select("block", F.lit(None).cast("int"), "keys", "ids"))
    return d.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_cut_block(buckets), _schema(CUT))


def dedup_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return spans(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB: the same rows as dedup_strings() where ids are unique; every 50-byte string is grouped by itself, as hexadecimal digits.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, q, length(h) // 2 - 49 - q AS last, substring(h, 2 * q + 1, 2 * (512 + 49)) AS part
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 512)) AS q FROM d)),
w AS (SELECT doc_id, q + i AS p, substring(part, 2 * i + 1, 100) AS w
      FROM (SELECT doc_id, q, part, unnest(range(0, least(512, last))) AS i FROM b)),
f AS (SELECT w, min(doc_id) AS least_id FROM w GROUP BY w HAVING max(doc_id) > min(doc_id)),
r AS (SELECT doc_id, p FROM w JOIN f USING (w) WHERE doc_id > least_id),
n AS (SELECT *, p - lag(p, 1, -51) OVER (PARTITION BY doc_id ORDER BY p) > 50 AS begins FROM r),
g AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM n),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM s),
t AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS n_spans, max(z) AS rest,
      string_agg(substring(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
