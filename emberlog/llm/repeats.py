"""Units of text (windows of lines, chunks) that occur before, found over all documents.

An occurrence is (doc_id, position); the smallest one of a digest is the first, all
others are repeats. Tasks settle what they can see themselves and send one row per
digest and slice of text (``SLICE`` bytes), so a digest that is everywhere arrives once per slice, not
once per occurrence: 32 MB of texts become one row of some 50 bytes. What was decided returns to a document as the numbers of its units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import order_id, pieces_of, row_key, texts

#: units of one document's bytes: their digests (16 bytes each), end to end
Digests = Callable[[bytes], bytes]
SLICE = 32 << 20

SENT = "k1 long, k2 long, id long, uid long, pos int, marks binary"
SENT_SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("uid", pa.int64()), ("pos", pa.int32()), ("marks", pa.binary())])


def _slice(part: pa.RecordBatch, digests: Digests) -> Iterator[pa.RecordBatch]:
    found = [digests(t.encode()) for t in part.column(2).to_pylist()]
    counts = np.array([len(x) // 16 for x in found], np.int64)
    n = int(counts.sum())
    if not n:
        return
    keys = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
    row = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    ids, uids = part.column(0).to_numpy(zero_copy_only=False)[row], part.column(1).to_numpy(zero_copy_only=False)[row]
    order = np.lexsort((pos, uids, ids, keys[:, 1], keys[:, 0]))
    k, i, u, p = keys[order], ids[order], uids[order], pos[order]
    new = np.r_[True, (k[1:] != k[:-1]).any(1)]
    group = np.cumsum(new) - 1
    lead = np.flatnonzero(new)
    yield pa.RecordBatch.from_arrays([pa.array(k[lead, 0]), pa.array(k[lead, 1]), pa.array(i[lead]), pa.array(u[lead]), pa.array(p[lead].astype(np.int32)), pa.nulls(len(lead), pa.binary())], schema=SENT_SCHEMA)
    first = lead[group]
    later = (i != i[first]) | (u != u[first]) | (p != p[first])
    if later.any():
        rows, marks = row[order][later], p[later].astype("<i4")
        o = np.argsort(rows, kind="stable")
        rows, marks = rows[o], marks[o]
        at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        ends = np.r_[at[1:], len(rows)]
        who = rows[at]
        i, u = part.column(0).to_numpy(zero_copy_only=False)[who], part.column(1).to_numpy(zero_copy_only=False)[who]
        blobs = pa.array([marks[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(i), pa.array(i), pa.array(u), pa.nulls(len(at), pa.int32()), blobs], schema=SENT_SCHEMA)


def _send(digests: Digests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, SLICE):
                yield from _slice(part, digests)

    return run


def marked(docs: DataFrame, digests: Digests) -> DataFrame:
    """docs (doc_id, text and more) with ``_marks`` (array<binary>) and ``_later`` (array<int>): numbers of the repeated units; null if there are none."""
    own = docs.withColumns({"_id": order_id(), "_uid": row_key()})
    sent = own.select(F.col("_id").alias("id"), F.col("_uid").alias("uid"), "text").mapInArrow(_send(digests), SENT)
    here = F.struct("id", "uid", "pos")
    sent = sent.withColumn("first", F.min(F.when(F.col("marks").isNull(), here)).over(Window.partitionBy("k1", "k2")))
    back = (
        sent.where(F.col("marks").isNotNull() | (here > F.col("first")))
        .groupBy(F.col("id").alias("_id"), F.col("uid").alias("_uid"))
        .agg(F.collect_list("marks").alias("_marks"), F.collect_list("pos").alias("_later"))
    )
    return own.join(back, ["_id", "_uid"], "left").drop("_id", "_uid")


def numbers(marks: list[bytes] | None, later: list[int] | None) -> np.ndarray:
    """The repeated units of one document, ascending."""
    if not marks and not later:
        return np.zeros(0, np.int64)
    return np.unique(np.concatenate([np.array(later or [], np.int64), *(np.frombuffer(m, "<i4").astype(np.int64) for m in marks or ())]))


def applied(docs: DataFrame, digests: Digests, cut: Callable[[bytes, np.ndarray], tuple], columns: str, schema: pa.Schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, then what ``cut(bytes, repeated units)`` returns as ``columns``."""
    frame = marked(docs, digests).select(*keep, "text", "_marks", "_later")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[: len(keep)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                text, marks, later = (part.column(len(keep) + k).to_pylist() for k in range(3))
                rows = [cut(t.encode(), numbers(m, p)) for t, m, p in zip(text, marks, later, strict=True)]
                made = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*part.schema.names[: len(keep)], *schema.names])

    return frame.mapInArrow(run, ", ".join([*fields, columns]))


__all__ = ["applied", "marked", "numbers", "texts"]
