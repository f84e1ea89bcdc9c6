"""Line dedup: three-line windows that occur before are removed.

A document's lines are its text split at line feeds. Every three consecutive lines make
a window (windows overlap). A window whose lines all occurred before, in this order, in
a document with a smaller doc_id or earlier in the same one, is repeated; its lines are
covered, and all covered lines go. The first occurrence stays. Windows are judged on
the input, not on what is left. Windows of blank lines only are not judged.

A text of fewer than three lines has no window and stays. Null texts are empty; null ids
come last; rows equal in id and text are one document; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positional, texts
from .repeats import applied

WINDOW = 3
RESULT = "n_lines int, n_removed int, n_spans int, kept_sha256 string, text string"
RESULT_SCHEMA = pa.schema([("n_lines", pa.int32()), ("n_removed", pa.int32()), ("n_spans", pa.int32()), ("kept_sha256", pa.string()), ("text", pa.string())])


def windows(text: bytes) -> list[tuple[int, bytes]]:
    """(first line, lines) of the windows that are judged."""
    lines = text.split(b"\n")
    out = []
    for i in range(len(lines) - WINDOW + 1):
        w = b"\n".join(lines[i : i + WINDOW])
        if not w.isspace() and len(w) >= WINDOW:
            out.append((i, w))
    return out


def digests(text: bytes) -> bytes:
    return b"".join([blake2b(w, digest_size=16).digest() for _, w in windows(text)])


def cut(text: bytes, repeated: np.ndarray) -> tuple:
    lines = text.split(b"\n")
    gone = np.zeros(len(lines) + 1, bool)
    if len(repeated):
        starts = np.array([i for i, _ in windows(text)])[repeated]
        for k in range(WINDOW):
            gone[starts + k] = True
    kept = b"\n".join([x for x, g in zip(lines, gone.tolist(), strict=False) if not g])
    spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum())
    return len(lines), int(gone.sum()), spans, sha256(kept).hexdigest(), kept.decode()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans (runs of removed lines), kept_sha256 and the remaining text."""
    return applied(texts(docs), digests, cut, RESULT, RESULT_SCHEMA, keep=("doc_id",))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the remaining texts; a document of which nothing is left goes, one that was blank before stays. n_chars follows the text."""
    frame, others = positional(docs)
    keep = ("doc_id", "given", *[f"c{k}" for k in range(len(others))])
    out = applied(frame, digests, cut, RESULT, RESULT_SCHEMA, keep=keep)
    out = out.where(~((F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^ \t\n\x0B\f\r]")))
    columns = {"doc_id": F.col("doc_id"), "text": F.when(F.col("given").isNotNull(), F.col("text")), **{c: F.col(f"c{k}") for k, c in enumerate(others)}}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in docs.columns])


#: DuckDB: the same rows as dedup_lines() where ids are unique.
ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i+1] || chr(10) || ls[i+2] AS w
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, w, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w
      WHERE regexp_matches(w, '[^ \\t\\n\\r\\f\\v]')) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (VALUES (0), (1), (2)) AS t(k)),
l AS (SELECT doc_id, ls[i] AS line, i, len(ls) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
m AS (SELECT l.doc_id, l.i, l.line, l.n, c.i IS NOT NULL AS gone FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM m),
a AS (SELECT doc_id, any_value(n)::INTEGER AS n_lines, count(*) FILTER (gone)::INTEGER AS n_removed,
      count(*) FILTER (begins)::INTEGER AS n_spans,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM s GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, n_spans, sha256(text) AS kept_sha256, text FROM a
"""
