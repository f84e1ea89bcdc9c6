"""Token ids kept as one wavelet matrix per shard.

A shard is a run of whole documents in ascending doc_id order. Its ids are stored
bit-plane by bit-plane, highest bit first; after each plane the ids with bit 0 move, in
order, before those with bit 1. A plane carries the number of its zeros and a count of
ones before every 512th bit, so that access, rank and select need no decoding of the rest.

File format: Parquet, one file per task and zstd-compressed, a row per shard with
``part, shard`` (order), ``start`` (ids of the part's earlier shards), ``n_tokens``,
``doc_ids``/``null_ids``/``lengths`` (per document), ``planes`` (packed bits), ``zeros`` and ``ranks``.

Nulls: a null text is empty (the end id alone); null doc_ids come first. Repeated ids
stand in text order. An empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, pieces_of, texts, tidied, tokenizer_path
from .token_ids import encoder as encoder_of

BLOCK = 512
SHARD = "part int, shard int, start long, n_tokens long, doc_ids binary, null_ids binary, lengths binary, planes binary, zeros array<long>, ranks binary"
SHARD_SCHEMA = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("lengths", pa.binary()), ("planes", pa.binary()), ("zeros", pa.list_(pa.int64())), ("ranks", pa.binary())])


class WaveletMatrix:
    def __init__(self, n: int, planes: np.ndarray, zeros: np.ndarray, ranks: np.ndarray):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, blocks = len(ids), -(-len(ids) // BLOCK)
        if n and int(ids.max()) >> bits:
            raise ValueError(f"the id {int(ids.max())} needs more than {bits} bits")
        planes, ranks = np.zeros((bits, blocks * BLOCK // 8), np.uint8), np.zeros((bits, blocks + 1), np.uint32)
        zeros = np.zeros(bits, np.int64)
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits):
            one = (now & now.dtype.type(1 << (bits - 1 - k))) != 0
            packed = np.packbits(one)
            planes[k, : len(packed)] = packed
            ranks[k, 1:] = np.cumsum(np.bitwise_count(planes[k].view("<u8")).reshape(blocks, BLOCK // 64).sum(1, dtype=np.uint32))
            low = now.compress(~one)
            zeros[k] = len(low)
            now = np.concatenate([low, now.compress(one)])
        return cls(n, planes, zeros, ranks)

    def decode(self) -> np.ndarray:
        """All ids in order: the moves of build(), undone from the last plane to the first."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n).view(bool)
            was = np.empty_like(now)
            # places are numbers: numpy is slower with masks
            was[np.flatnonzero(~one)] = now[: self.zeros[k]]
            was[np.flatnonzero(one)] = now[self.zeros[k] :] | now.dtype.type(1 << (len(self.planes) - 1 - k))
            now = was
        return now

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before bit i."""
        b = i // BLOCK
        part = self.planes[k, b * BLOCK // 8 : -(-i // 8)]
        bits = int(np.bitwise_count(part).sum())
        if i % 8 and len(part):
            bits -= int(part[-1] & (0xFF >> (i % 8))).bit_count()
        return int(self.ranks[k, b]) + bits

    def access(self, i: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            one = self.planes[k, i // 8] >> (7 - i % 8) & 1
            value = value << 1 | int(one)
            r = self._ones(k, i)
            i = int(self.zeros[k]) + r if one else i - r
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where ids equal to token among the first i end up after the last plane."""
        lo, hi = 0, i
        if token >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if token >> (len(self.planes) - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often token occurs among the first i ids."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Where token occurs for the j-th time (from 0)."""
        lo, hi = self._range(token, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        at = lo + j
        for k in range(len(self.planes) - 1, -1, -1):
            one = bool(token >> (len(self.planes) - 1 - k) & 1)
            at = self._select_bit(k, one, at - int(self.zeros[k]) if one else at)
        return at

    def _select_bit(self, k: int, one: bool, j: int) -> int:
        counts = self.ranks[k].astype(np.int64)
        if not one:
            counts = np.arange(len(counts), dtype=np.int64) * BLOCK - counts
        b = int(np.searchsorted(counts, j, "right")) - 1
        bits = np.unpackbits(self.planes[k, b * BLOCK // 8 : (b + 1) * BLOCK // 8])
        return b * BLOCK + int(np.flatnonzero(bits == one)[j - counts[b]])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]


def _shard_row(part, shard, start, docs, ids, lengths, bits) -> pa.RecordBatch:
    w = WaveletMatrix.build(np.concatenate(ids), bits)
    values = [part, shard, start, w.n, np.array([d or 0 for d in docs], "<i8").tobytes(), np.packbits([d is None for d in docs]).tobytes(), np.array(lengths, "<i8").tobytes(), w.planes.tobytes(), w.zeros.tolist(), w.ranks.astype("<u4").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, SHARD_SCHEMA, strict=True)], schema=SHARD_SCHEMA)


def encode_shards(path: str, end_id: int, bits: int, most: int):
    tail = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, start, n = TaskContext.get().partitionId(), 0, 0, 0
        encoder, docs, ids, lengths = encoder_of(path, False), [], [], []
        for batch in batches:
            for some in pieces_of(batch):
                for doc, got in zip(some.column(0).to_pylist(), encoder.encode(some.column(1)), strict=True):
                    docs.append(doc)
                    ids += (got, tail)
                    lengths.append(len(got) + 1)
                    n += lengths[-1]
                    if n >= most:
                        yield _shard_row(part, shard, start, docs, ids, lengths, bits)
                        shard, start, n, docs, ids, lengths = shard + 1, start + n, 0, [], [], []
        if docs:
            yield _shard_row(part, shard, start, docs, ids, lengths, bits)

    return run


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2, bits: int = 16, most: int = 1 << 20, tasks: int | None = None) -> None:
    """Writes the shards under ``out``. ``bits``: of the largest id; ``most``: ids at which a shard closes."""
    path = path or tokenizer_path("word_bpe_49k.json")
    d = texts(docs)
    d = d.repartitionByRange(tasks, "doc_id") if tasks else d.repartitionByRange("doc_id")
    (d.sortWithinPartitions("doc_id", "text").mapInArrow(tidied(encode_shards(path, end_id, bits, most)), SHARD).write.option("compression", "zstd").parquet(out))


def matrix(row: dict) -> WaveletMatrix:
    """Of one row of the files."""
    bits = len(row["zeros"])
    return WaveletMatrix(row["n_tokens"], np.frombuffer(row["planes"], np.uint8).reshape(bits, -1), np.array(row["zeros"], np.int64), np.frombuffer(row["ranks"], "<u4").reshape(bits, -1))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {f.name: batch.column(k)[i].as_py() for k, f in enumerate(batch.schema)}
            ids = matrix(row).decode().astype("<u4")
            lengths, docs = np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["doc_ids"], "<i8")
            null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=len(docs)).astype(bool)
            ends = np.cumsum(lengths)
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs.astype(np.int64), mask=null), pa.array(row["start"] + row["before"] + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    shards = spark.read.schema(SHARD).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # a row per written file, so the broadcast side doesn't grow with the rows
    return shards.join(F.broadcast(before), "part").select("start", "before", "n_tokens", "doc_ids", "null_ids", "lengths", "planes", "zeros", "ranks").mapInArrow(tidied(_documents), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    out = new_path(docs.sparkSession, "tokens")
    write(docs, out)
    return read(docs.sparkSession, out)
