"""Importance resampling to a target distribution, by inverted postings in buckets.

Features are runs of words, hashed into buckets. How much commoner a bucket is in the target (the
benchmark) than in the documents is its gain; a document's weight is the sum of its features' gains.
Weights plus Gumbel noise from a hash of the id, the highest first, are a draw without replacement.

1. Texts are cut in slices of bounded bytes and rows. A slice gives, per range of buckets, one row of postings:
   (bucket, document's number in the slice, count), packed and sorted, and one row that names its documents. Both are a stored table.
2. Counts of all buckets in both corpora are summed; there are ``buckets`` of them, whatever the input.
3. Postings are dealt by range of buckets and part: slices are dealt to parts, so a bucket that is in every
   document is split. The range's counts in both corpora come to every part of it (co-grouped), the task
   computes the gains and turns postings into contributions per document, summed over the range.
4. Contributions are dealt by slice, summed by document, and meet the row that names the documents.
5. Scores are sorted by range partitions; places come from the partitions' counts.

Every step streams over sorted rows, so a task holds one slice, or one range of buckets, at a time.

Nulls: a null text has no words; a null doc_id is hashed as an empty one and comes after others in ties. Each row is a
document, so repeated rows count, and are drawn, as often as they occur. Equal scores go to the smaller doc_id. Without a
target all counts of it are 0. An empty table gives no rows. A text is read as a whole however long it is; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import encoded, pieces_of, stored, texts, tidied
from .words import lower_ascii

#: features are counted modulo BUCKETS; they are dealt in RANGES ranges
BUCKETS, RANGES = 10_000, 64
#: a slice has at most so many bytes of text (or one text) and so many documents; a part has so many slices
SLICE_BYTES, SLICE_ROWS, PART_SLICES = 4 << 20, 1 << 15, 256

#: a slice's row of names (ids to n_features), or its postings in one range of buckets (buckets to counts: u2, u2 and u4)
SLICES = "slice long, rng int, ids array<long>, n_words array<long>, n_features array<long>, buckets binary, docs binary, counts binary"
_LONGS = pa.list_(pa.int64())
_SCHEMA = pa.schema([("slice", pa.int64()), ("rng", pa.int32()), ("ids", _LONGS), ("n_words", _LONGS), ("n_features", _LONGS), ("buckets", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
#: longer features are hashed one by one
_LONG = 48


def _table() -> np.ndarray:
    """CRC-32 of single bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_CRC = _table()


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of data[start:end] for many ranges at once, byte by byte, the longest first."""
    size = end - start
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    size, at = size[order], start[order]
    first = int(np.count_nonzero(size > _LONG))  # these are longer and come first
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for k in range(_LONG):
        n = int(np.searchsorted(-size[first:], -k, "left"))
        if not n:
            break
        part = crc[first : first + n]
        crc[first : first + n] = _CRC[(part ^ data[at[first : first + n] + k]) & 255] ^ (part >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(first):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]])
    out = np.empty(len(size), np.uint32)
    out[order] = crc
    return out


def _word_bytes() -> np.ndarray:
    """Table: digits, small letters and all bytes beyond ASCII make words."""
    t = np.zeros(256, bool)
    t[48:58] = t[97:123] = t[128:] = True
    return t


_WORD = _word_bytes()


def features(low: np.ndarray, at: np.ndarray, longest_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case texts end to end with n+1 limits: words per text, and text and crc32 of every feature."""
    inside = _WORD[low]
    before = np.r_[False, inside[:-1]]
    limits = at[(at > 0) & (at < len(low))]
    before[limits] = False
    after = np.r_[inside[1:], False]
    after[limits - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(at, start, "right") - 1
    n_words = np.bincount(doc, minlength=len(at) - 1)
    if longest_run == 1:
        return n_words, doc, crc32s(low, start, end)
    # words with one space behind each, so that a run is one range
    size = end - start + 1
    new = np.cumsum(size) - size
    line = np.full(int(size.sum()), 32, np.uint8)
    within = np.arange(len(line)) - np.repeat(new, size)
    letters = within < np.repeat(size - 1, size)
    line[letters] = low[(np.repeat(start, size) + within)[letters]]
    docs, crcs = [], []
    for run in range(1, longest_run + 1):
        first = np.arange(max(0, len(start) - run + 1))
        first = first[doc[first] == doc[first + run - 1]]
        docs.append(doc[first])
        crcs.append(crc32s(line, new[first], (new + size - 1)[first + run - 1]))
    return n_words, np.concatenate(docs), np.concatenate(crcs)


def _parts(low: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about SLICE_BYTES that end between words."""
    start = 0
    while start < len(low):
        end = start + SLICE_BYTES
        while end < len(low) and _WORD[low[end - 1]]:
            more = np.flatnonzero(~_WORD[low[end : end + SLICE_BYTES]])
            end += int(more[0]) + 1 if len(more) else SLICE_BYTES
        yield low[start:end]
        start = end


def _counted(low: np.ndarray, at: np.ndarray, longest_run: int, buckets: int) -> tuple[np.ndarray, ...]:
    """Words and features of every text; and bucket, text and count of every posting, sorted."""
    if len(at) == 2 and len(low) > 2 * SLICE_BYTES and longest_run == 1:
        n, total = 0, np.zeros(buckets, np.int64)
        for part in _parts(low):
            words, _, crc = features(part, np.array([0, len(part)]), 1)
            n += int(words[0])
            total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        return np.array([n]), np.array([n]), found, np.zeros(len(found), np.int64), total[found]
    n_words, doc, crc = features(low, at, longest_run)
    code, counts = np.unique((crc % np.uint32(buckets)).astype(np.int64) * SLICE_ROWS + doc, return_counts=True)
    return n_words, np.bincount(doc, minlength=len(n_words)), code // SLICE_ROWS, code % SLICE_ROWS, counts


def _postings(longest_run: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32  # the same when a task is run again
        width = math.ceil(buckets / RANGES)
        lower = lower_ascii()
        for batch in batches:
            for piece in (p for k in range(0, batch.num_rows, SLICE_ROWS) for p in pieces_of(batch.slice(k, SLICE_ROWS), SLICE_BYTES)):
                data, at = encoded(piece.column(1))
                n_words, n_features, bucket, docs, counts = _counted(lower[data], at, longest_run, buckets)
                rows: list[tuple] = [(number, None, piece.column(0).to_pylist(), n_words, n_features, None, None, None)]
                edge = np.searchsorted(bucket, np.arange(RANGES + 1) * width)
                for r, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                    if a < b:
                        rows.append((number, r, None, None, None, (bucket[a:b] - r * width).astype("<u2").tobytes(), docs[a:b].astype("<u2").tobytes(), counts[a:b].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
                number += 1

    return run


def _totals(buckets: int):
    """Counts of the buckets in the postings that a task reads."""
    width = math.ceil(buckets / RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * RANGES, np.int64)
        for batch in batches:
            for r, b, c in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                np.add.at(total, np.frombuffer(b, "<u2").astype(np.int64) + r * width, np.frombuffer(c, "<u4"))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    return run


def bucket_counts(slices: DataFrame, buckets: int, name: str) -> DataFrame:
    """bucket and its count: ``buckets`` rows at most."""
    rows = slices.where("rng is not null").select("rng", "buckets", "counts").mapInArrow(_totals(buckets), "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias(name))


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    return math.floor(1000 * math.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets))))


def _contributions(all_s: int, all_t: int, buckets: int):
    """Rows of a range and part come together: first its buckets' counts in both corpora, then its postings, slice by slice."""
    width = math.ceil(buckets / RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = np.zeros(width, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for r, number, both, b, d, c in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if both is not None:
                    gains = np.zeros(width, np.int64)
                    for x in both:
                        gains[x["bucket"] - r * width] = gain(x["s"], x["t"], all_s, all_t, buckets)
                    continue
                docs, n = np.frombuffer(d, "<u2"), np.frombuffer(c, "<u4").astype(np.int64)
                order = np.argsort(docs, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(docs[order].astype(np.int64)) != 0])
                sums = np.add.reduceat((gains[np.frombuffer(b, "<u2")] * n)[order], first)
                out.append((number, docs[order][first].tobytes(), sums.astype("<i8").tobytes()))
            if out:
                number, docs, sums = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(docs, pa.binary()), pa.array(sums, pa.binary())], names=["slice", "docs", "sums"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a slice come together: first the one that names its documents, then contributions to them."""
    names, total = None, np.zeros(0, np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        if names is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in names), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    for batch in batches:
        for ids, n_words, n_features, docs, sums in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if ids is not None:
                yield from done()
                names, total = (ids, n_words, n_features), np.zeros(len(ids), np.int64)
            else:
                total[np.frombuffer(docs, "<u2")] += np.frombuffer(sums, "<i8")
    yield from done()


def weights(docs: DataFrame, target: DataFrame, longest_run: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs; target has a column text."""
    slices = stored(texts(docs).mapInArrow(tidied(_postings(longest_run, buckets)), SLICES), "postings")
    wanted = texts(target.select(F.lit(None).cast("long").alias("doc_id"), "text")).mapInArrow(tidied(_postings(longest_run, buckets)), SLICES)
    s, t = bucket_counts(slices, buckets, "s"), stored(bucket_counts(wanted, buckets, "t"), "target-buckets")
    both = stored(s.join(t, "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t")), "buckets")
    all_s = both.agg(F.sum("s")).first()[0] or 0
    all_t = t.agg(F.sum("t")).first()[0] or 0
    parts = max(1, math.ceil(slices.where("rng is null").count() / PART_SLICES))
    width = math.ceil(buckets / RANGES)
    ranges = both.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("rng")).agg(F.collect_list(F.struct("bucket", "s", "t")).alias("both"))
    none = F.lit(None).cast("binary")
    ranges = ranges.select("rng", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("long").alias("slice"), "both", none.alias("buckets"), none.alias("docs"), none.alias("counts"))
    postings = slices.where("rng is not null").select("rng", F.pmod(F.xxhash64("slice"), F.lit(parts)).cast("int").alias("part"), "slice", F.lit(None).cast(ranges.schema["both"].dataType).alias("both"), "buckets", "docs", "counts")
    dealt = ranges.unionByName(postings).repartition("rng", "part").sortWithinPartitions("rng", "part", F.asc_nulls_first("slice"))
    given = dealt.select("rng", "slice", "both", "buckets", "docs", "counts").mapInArrow(tidied(_contributions(all_s, all_t, buckets)), "slice long, docs binary, sums binary")
    names = slices.where("rng is null").select("slice", "ids", "n_words", "n_features", none.alias("docs"), none.alias("sums"))
    empty = [F.lit(None).cast("array<long>").alias(c) for c in ("ids", "n_words", "n_features")]
    by_slice = names.unionByName(given.select("slice", *empty, "docs", "sums")).repartition("slice").sortWithinPartitions("slice", F.col("ids").isNull())
    return by_slice.select("ids", "n_words", "n_features", "docs", "sums").mapInArrow(_summed, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest_run: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null if not drawn) of every row of docs.

    Of the N documents with at least ``least_words`` words, floor(percent * N / 100) are drawn.
    """
    rows = weights(docs, target, longest_run, buckets).select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    placed = numbered(rows, [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")])
    drawn = percent * placed.where("able").count() // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("place") < drawn), F.col("place") + 1).alias("rank"))


#: crc32 byte by byte over distinct words, with a table made by its rule
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT range AS i, range::BIGINT AS v, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS c FROM bits WHERE k = 8),
w AS (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM (SELECT doc_id, text FROM documents)
  UNION ALL SELECT 'b', item_id, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
n AS (SELECT side, id, word, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM n)),
f AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) + 1, 2), lambda p: ('0x' || x[p:p + 1])::BIGINT)), lambda a, b: xor(c[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) % 10000 AS bucket FROM h, crc),
p AS (SELECT side, id, bucket, sum(n.n)::BIGINT AS n FROM n JOIN f USING (word) GROUP BY ALL),
u AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM p GROUP BY bucket),
o AS (SELECT sum(s) AS alls, sum(t) AS allt FROM u),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (alls + 10000) / ((s + 1) * (allt + 10000))))::BIGINT AS gain FROM u, o),
d AS (SELECT p.id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM p JOIN g USING (bucket) WHERE side = 'd' GROUP BY p.id),
a AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM documents LEFT JOIN d USING (doc_id)),
b AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score, n_features >= 20 AS able FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS able_rows FROM b)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * able_rows // 100 THEN place END AS rank FROM c
"""
