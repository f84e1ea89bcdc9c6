"""Near-duplicates by SetSketch registers.

A document's set holds the distinct shingles of its words. Its sketch has ``M``
registers; each keeps, as an exponent on a scale of base ``B``, the smallest of the
shingles' exponential hashes (truncated to 16 bits). Sketches of parts merge by the
larger register. Groups of ``ROWS`` registers are bands; documents that agree on a
band are candidates: at a similarity of 0.8 a pair is missed with a probability of
(1 - 0.8**6)**48, 5 in 10**7. For candidates the similarity is estimated from all registers
jointly by maximum likelihood; those within reach of the threshold are confirmed on the full sets.

Work within a band value is linear at first: documents with equal sets are one class, and a value's members are
held against one of them only. Confirmed links give components. Where a value's
members then lie in several components, those outside its largest are held against all members
by an inverted index of their full sets: ``BLOCK`` of the former and as many of the latter in a task; only confirmed links
that join components leave it. So no link that would join components is lost, no pairs are emitted, and members of one large
component are never held against each other.

Documents are known by a hash of id and text, so that a repeated id with another text is another document. Nulls: null and
blank texts have the empty set and are linked with nothing. A null
doc_id is linked with nothing, is kept, and its component is null. Rows equal in id and
text are one document and get the same answer. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, mix, order_id, pieces_of, row_key, stored, texts, tidied, without
from .graph import components
from .words import lower_ascii, white_space, words

M, ROWS, B, A, Q = 288, 6, 1.001, 20.0, (1 << 16) - 2
MARGIN = 0.13
BLOCK, SALTS = 2000, 16
#: bytes of text taken at once; a worker's arrays of numbers take some 80 times as much, and are faster in a cache
SLICE = 1 << 19
_ODD = mix(np.arange(1001, 1001 + M, dtype=np.uint64)) | np.uint64(1)
_TURN = mix(np.arange(9001, 9001 + M, dtype=np.uint64))
_LOWER, _WORD = lower_ascii(), white_space()


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    w = words(data, at, _WORD, _LOWER[data])
    limits = np.searchsorted(w.doc, np.arange(len(at)))
    h = w.hash
    if len(h) >= size:
        rolled = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            rolled = mix(rolled) + h[k : len(h) - size + 1 + k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:  # the whole sequence as one
            one = h[a : a + 1]
            for k in range(a + 1, b):
                one = mix(one) + h[k : k + 1]
            out.append(mix(one + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of sets that aren't empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((len(sets), M), np.uint64)
    for k in range(M):
        v = (joined ^ _TURN[k]) * _ODD[k]
        v ^= v >> np.uint64(32)
        v *= _ODD[k]
        least[:, k] = np.minimum.reduceat(v, starts)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


_GRID = np.linspace(0, 1, 201)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - up - down
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    p, q = np.maximum(_p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(_p(np.maximum(v - u * j, 0)), 1e-12)
    best = np.argmax(up * np.log(p) + down * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12)), 1)
    return j[np.arange(len(j)), best]


SKETCH = "id long, uid long, doc_id long, n long, d1 long, d2 long, sketch binary"
SKETCH_SCHEMA = pa.schema([("id", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.binary())])


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, SLICE):
                sets = shingle_sets(*encoded(part.column(3)), size)
                full = [i for i, s in enumerate(sets) if len(s)]
                d1, d2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                blobs: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, k in zip(full, sketches([sets[i] for i in full]), strict=True):
                        blobs[i] = k.astype("<u2").tobytes()
                for i in full:
                    d1[i], d2[i] = mix(sets[i]).sum(dtype=np.uint64), mix(sets[i] + np.uint64(77)).sum(dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(blobs, pa.binary())], schema=SKETCH_SCHEMA)

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, M // ROWS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(M // ROWS, dtype=np.uint64), k.shape[:2])
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + k[:, :, r])
        node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), k.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), "<u2").reshape(part.num_rows, -1) for k in (4, 5))
                n, m = (part.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
                keep = pa.array(similarity(x, y, n, m) >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, SLICE):
                blobs = [np.ascontiguousarray((s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for s in shingle_sets(*encoded(part.column(1)), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["node", "set"])

    return run


def _wide(blob: bytes) -> np.ndarray:
    x = np.zeros((len(blob) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return x.view("<u8").ravel()


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _wide(x.as_py()), _wide(y.as_py())
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _joining(percent: int):
    """Links of full sets that join components: of the ``outside`` members of a group with all its members."""

    def run(table: pa.Table) -> pa.Table:
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        outside = np.flatnonzero(np.array(table.column("outside").to_pylist(), bool))
        sets = [_wide(x.as_py()) for x in table.column("set")]
        size = np.array([len(x) for x in sets])
        kinds, comp = np.unique(comp, return_inverse=True)
        root = list(range(len(kinds)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        _, word = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        first = np.r_[0, np.cumsum(size)]
        order = np.argsort(word, kind="stable")
        lists, begin = owner[order], np.r_[0, np.cumsum(np.bincount(word))]
        links = []
        for x in outside.tolist():
            own = word[first[x] : first[x + 1]]
            n = begin[own + 1] - begin[own]
            ends = np.cumsum(n)
            others = lists[np.repeat(begin[own] - (ends - n), n) + np.arange(int(ends[-1]))]
            common = np.bincount(others, minlength=len(sets))
            for y in np.flatnonzero((100 * common >= percent * (size[x] + size - common)) & (comp != comp[x])).tolist():
                a, b = find(int(comp[x])), find(int(comp[y]))
                if a != b:
                    root[a] = b
                    links.append((node[x], node[y]))
        return pa.table({"a": pa.array([min(v) for v in links], pa.int64()), "b": pa.array([max(v) for v in links], pa.int64())})

    return run


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough."""
    x = reps.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    y = reps.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    close = pairs.join(x, "a").join(y, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    close = close.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_likely(percent / 100 - MARGIN), "a long, b long")
    with_a = close.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long").distinct(), "links")


def _across(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components among the members of a band value."""
    wide = members.where("members > 2").select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    kinds = wide.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("kinds"))
    # blocks of the members outside the largest component, and of all members
    several = kinds.where("kinds > 1").select("key", F.col("top.comp").alias("main"), F.ceil((F.col("members") - F.col("top.n")) / BLOCK).cast("int").alias("rows"), F.ceil(F.col("members") / BLOCK).cast("int").alias("columns"))
    # a value that is in a third of all documents is joined in SALTS parts
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = wide.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(several, ["key", "salt"])
    at = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    all_members = met.select("key", "node", "comp", F.lit(False).alias("outside"), at("columns").alias("j"), every("rows").alias("i"))
    outsiders = met.where("comp <> main").select("key", "node", "comp", F.lit(True).alias("outside"), at("rows").alias("i"), every("columns").alias("j"))
    split = all_members.unionByName(outsiders)
    return stored(split.join(sets, "node").groupBy("key", "i", "j").applyInArrow(_joining(percent), "a long, b long").distinct(), "links")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, uid, n_shingles, component_id, kept (doc_id = component_id) and lead (the one of its component with the smallest id) of every document."""
    own = docs.select(order_id().alias("id"), row_key().alias("uid"), "doc_id", "text")
    sketch = stored(own.mapInArrow(tidied(_sketch(size)), SKETCH), "sketches")
    able = sketch.where("n > 0 and doc_id is not null")
    # equal sets are one class, spoken for by its smallest document
    best = able.groupBy("d1", "d2").agg(F.min(F.struct("id", "uid", "n", "sketch")).alias("r"))
    reps = stored(best.select(F.col("r.id").alias("id"), F.col("r.uid").alias("node"), F.col("r.n").alias("n"), F.col("r.sketch").alias("sketch"), "d1", "d2"), "classes")
    bands = stored(reps.select("node", "sketch").mapInArrow(_bands, "key long, node long"), "bands")
    values = stored(bands.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1"), "values")
    members = stored(bands.join(values, "key"), "members")
    first = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    named = members.select("node").distinct().join(reps.select("node", "id"), "node")
    text = own.select("id", F.col("uid").alias("node"), "text").join(named, ["id", "node"]).dropDuplicates(["node"]).select("node", "text")
    sets = stored(text.mapInArrow(tidied(_sets(size)), "node long, set binary"), "sets")
    links = _confirmed(first, reps, sets, percent)
    comp = components(links)
    more = _across(members, comp, sets, percent)
    if not more.isEmpty():
        comp = components(links.union(more))

    # a component is named by its document with the smallest id
    linked = reps.select("id", "node", "d1", "d2").join(comp, "node")
    smallest = linked.groupBy("comp").agg(F.min(F.struct("id", "node")).alias("least"))
    found = linked.join(smallest, "comp").select("d1", "d2", "least")
    found = reps.join(found, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least", F.struct("id", "node")).alias("least"))
    out = sketch.join(found, ["d1", "d2"], "left").select("doc_id", "id", "uid", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least")).alias("least"))
    own_comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == own_comp, F.lit(True))
    return out.select("doc_id", "uid", "n_shingles", own_comp.alias("component_id"), kept.alias("kept"), F.coalesce(F.col("uid") == F.col("least.node"), F.lit(True)).alias("lead"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) and kept of every document."""
    return groups(texts(docs), size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group: that with the smallest doc_id."""
    gone = groups(texts(docs), size, percent).where("not lead").select(F.col("doc_id").alias("id"), "uid").distinct()
    return without(docs, stored(gone, "copies"))


#: DuckDB: the same rows as near_duplicates(size=2) where ids are unique and not null.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) > 1 THEN ws[i] || ' ' || ws[i + 1] ELSE ws[1] END AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT u AS node, u AS place FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.place = e.u),
c AS (SELECT node, min(place) AS comp FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(comp, d.doc_id) AS component_id, d.doc_id = coalesce(comp, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.node
"""
