"""Best-fit packing by hierarchical residual packing.

Each task cuts its documents into pieces of at most ``limit`` ids and packs the short
pieces best-fit, longest first. Bins that are full or nearly so are final; the
others become items of the next round, which runs on an eighth of the tasks, until
one task holds what is left or a round gains next to nothing. A bin never holds more
than ``limit`` ids, so a row stays small, and a task works on windows of bounded size.

Nulls: a null text is empty and becomes the one end id; a null doc_id is kept as it is.
Repeated rows are packed as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import positions
from .common import pieces_of, stored, texts, tidied, tokenizer_path
from .token_ids import encoder as encoder_of

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
ROUND = PIECE + ", bin binary"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bin", pa.binary())])
MEMBER = np.dtype([("doc_id", "<i8"), ("null", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])


def best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each to the fullest bin that still takes it."""
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    bins: list[list[int]] = []
    mask = 0  # bit f: some bin has f ids free
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            f = size + (fits & -fits).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                mask &= ~(1 << f)
            bins[b].append(i)
            f -= size
        else:
            b, f = len(bins), limit - size
            bins.append([i])
        if f:
            free[f].append(b)
            mask |= 1 << f
    return bins


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first may be shorter, so only it needs company."""
    first = n % limit or limit
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def rows_of(m: np.ndarray, seq: np.ndarray) -> pa.RecordBatch:
    """Rows of members that lie sequence by sequence."""
    ends = np.cumsum(m["length"].astype(np.int64))
    begin = ends - m["length"]
    new = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
    offset = begin - np.repeat(begin[new], np.diff(np.r_[new, len(seq)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(m["doc_id"].astype(np.int64), mask=m["null"].copy()), pa.array(m["piece"].astype(np.int32)), pa.array(m["start"].astype(np.int64)), pa.array(m["length"].astype(np.int64)), pa.array(m["crc"].astype(np.int64)), pa.array(seq), pa.array(offset), pa.nulls(len(m), pa.binary())],
        schema=SCHEMA,
    )


class _Out:
    """Rows of pieces in final bins, and the open bins."""

    def __init__(self, round_no: int, limit: int, slack: int):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.base = (round_no << 56) | ((context.partitionId() if context else 0) << 32)
        self.n, self.limit, self.slack = 0, limit, slack
        self.closed: list[np.ndarray] = []
        self.seq: list[np.ndarray] = []
        self.open: list[tuple[int, int, bytes]] = []  # id, size, members

    def close(self, members: np.ndarray) -> None:
        self.closed.append(members)
        self.seq.append(np.full(len(members), self.base + self.n, np.int64))
        self.n += 1

    def pack(self, items: list[np.ndarray]) -> None:
        """items: members of one open bin each."""
        sizes = np.array([int(m["length"].sum()) for m in items], np.int64)
        for b in best_fit(sizes, self.limit):
            members = np.concatenate([items[i] for i in b])
            size = int(sizes[b].sum())
            if self.limit - size <= self.slack:
                self.close(members)
            else:
                self.open.append((self.base + self.n, size, members.tobytes()))
                self.n += 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.closed:
            yield rows_of(np.concatenate(self.closed), np.concatenate(self.seq))
        if self.open:
            ids, sizes, bins = zip(*self.open, strict=True)
            made = {"length": pa.array(sizes, pa.int64()), "sequence_id": pa.array(ids, pa.int64()), "bin": pa.array(bins, pa.binary())}
            yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(len(bins), f.type)) for f in SCHEMA], schema=SCHEMA)
        self.closed, self.seq, self.open = [], [], []


def first_round(path: str, end_id: int, limit: int, slack: int, window: int):
    tail = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, short = encoder_of(path, True), _Out(0, limit, slack), []
        for batch in batches:
            for part in pieces_of(batch, 4 << 20):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids = np.concatenate([ids, tail]).tobytes()
                    for k, (start, length) in enumerate(cut(len(ids) // 4, limit)):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        member = np.array([(doc or 0, doc is None, k, start, length, crc)], MEMBER)
                        if length == limit:
                            out.close(member)
                        else:
                            short.append(member)
                if len(short) >= window:
                    out.pack(short)
                    short = []
                if len(out.closed) + len(out.open) > 20_000:
                    yield from out.batches()
        out.pack(short)
        yield from out.batches()

    return run


def next_round(round_no: int, limit: int, slack: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, items = _Out(round_no, limit, slack), []
        for batch in batches:
            items += [np.frombuffer(b, MEMBER) for b in batch.column(0).to_pylist()]
            if len(items) >= window:
                out.pack(items)
                items = []
                yield from out.batches()
        out.pack(items)
        yield from out.batches()

    return run


def patterns(counts: dict[int, int], limit: int) -> list[tuple[dict[int, int], int]]:
    """best_fit() over items of which only the number of each size is known: (how often a bin holds each size, number of such bins)."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}  # by free ids
    for size in sorted(counts, reverse=True):
        n = counts[size]
        new: list[tuple[int, dict[int, int], int]] = []

        def put(free: int, held: dict[int, int], bins: int, size: int = size, new: list = new) -> int:
            """As many items as go into bins of one kind, of which each is filled before the next; returns how many are left."""
            nonlocal n
            each = free // size
            filled = min(bins, n // each)
            if filled:
                new.append((free - each * size, {**held, size: each}, filled))
                n -= filled * each
            if n and filled < bins:
                new.append((free - n * size, {**held, size: n}, 1))
                n, filled = 0, filled + 1
            return bins - filled

        for free in sorted(f for f in groups if f >= size):
            kept = []
            for held, bins in groups[free]:
                left = put(free, held, bins) if n else bins
                if left:
                    kept.append((held, left))
            groups[free] = kept
        if n:
            put(limit, {}, -(-n // (limit // size)))
        for free, held, bins in new:
            groups.setdefault(free, []).append((held, bins))
    return [g for some in groups.values() for g in some]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members, seq = [], []
        for number, bins in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            some = np.concatenate([np.frombuffer(b, MEMBER) for b in bins])
            members.append(some)
            seq.append(np.full(len(some), number, np.int64))
        if members:
            yield rows_of(np.concatenate(members), np.concatenate(seq))


def root(opened: DataFrame, limit: int, base: int) -> DataFrame:
    """All open bins (sequence_id, length, bin) in one best-fit by sizes. base: number of the first sequence."""
    spark = opened.sparkSession
    counts = {r.length: r["count"] for r in opened.groupBy("length").count().collect()}  # limit rows at most
    places, used = [], dict.fromkeys(counts, 0)
    for held, bins in patterns(counts, limit):
        for size, each in held.items():
            places.append((size, used[size], used[size] + bins * each, each, base))
            used[size] += bins * each
        base += bins
    # a size's ranges, a few thousand rows that limit bounds
    table = spark.createDataFrame(places, "length long, low long, high long, each long, base long")
    numbered = positions(opened, ["length"], "sequence_id", "_place")
    dealt = numbered.join(F.broadcast(table), "length").where("_place >= low and _place < high")
    target = F.col("base") + F.floor((F.col("_place") - F.col("low")) / F.col("each"))
    whole = dealt.groupBy(target.cast("long").alias("number")).agg(F.sort_array(F.collect_list(F.struct("sequence_id", "bin"))).alias("bins"))
    return whole.select("number", F.col("bins.bin").alias("bins")).mapInArrow(_joined, ROUND)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, limit: int = 1024, slack: int = 4, window: int = 200_000, fan_in: int = 8) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``slack``: a bin with so many free ids at most is final before the root.
    ``window``: items that one best-fit pass of a task takes at most.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    done = stored(texts(docs).mapInArrow(tidied(first_round(path, end_id, limit, slack, window)), ROUND), "packing")
    parts = [done.where("bin is null")]
    opened = done.where("bin is not null").select("sequence_id", "length", "bin")
    left, tasks, k = opened.count(), None, 0
    while left:
        if tasks is None:  # those of the first round, as its ids tell
            tasks = opened.agg(F.max(F.shiftright("sequence_id", 32))).first()[0] + 1
        least = -(-left // window)
        if tasks <= fan_in * least:  # the root is next
            break
        k += 1
        tasks = tasks // fan_in
        done = stored(opened.select("bin").repartition(tasks).mapInArrow(next_round(k, limit, slack, window), ROUND), "packing")
        parts.append(done.where("bin is null"))
        opened = done.where("bin is not null").select("sequence_id", "length", "bin")
        left = opened.count()
    if left:
        parts.append(root(opened, limit, (k + 1) << 56))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[F.col(c.split()[0]) for c in PIECE.split(", ")])
