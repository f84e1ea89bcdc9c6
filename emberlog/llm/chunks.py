"""Substring dedup by content-defined chunking.

A gear hash rolls over the UTF-8 bytes (it depends on the last 32 bytes only). A
position is a cut where the hash's top ``BITS`` bits are 0 and no such position lies in the ``LEAST``
bytes before, so cuts depend on the bytes around them alone and return soon after an
insertion. Stretches of more than ``MOST`` bytes are cut every ``MOST`` bytes. A chunk
whose digest occurs in a document with a smaller doc_id, or earlier in the same one, is a
copy, and every copy is removed, however short. A copied document has the same cuts as its original, so it goes whole.

Null texts are empty (no chunks); null ids come last; rows equal in id and text are one
document; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, texts
from .repeats import applied

BITS, LEAST, MOST = 5, 16, 4096
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
RESULT = "n_bytes long, n_chunks int, n_copied_chunks int, n_removed long, n_spans int, kept_sha256 string, text string"
RESULT_SCHEMA = pa.schema([("n_bytes", pa.int64()), ("n_chunks", pa.int32()), ("n_copied_chunks", pa.int32()), ("n_removed", pa.int64()), ("n_spans", pa.int32()), ("kept_sha256", pa.string()), ("text", pa.string())])


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i-j]] << j over the last 32 bytes."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        add = h[:-step] << np.uint32(step) if len(h) > step else h[:0]
        h = h.copy()
        h[step:] += add
    return h


def cuts(text: bytes) -> np.ndarray:
    """Chunk limits, from 0 to the length."""
    n = len(text)
    if not n:
        return np.zeros(1, np.int64)
    # bits 20 and up hold 20 bytes at least
    at = np.flatnonzero((gear(np.frombuffer(text, np.uint8)) >> np.uint32(32 - BITS)) == 0) + 1
    at = at[np.diff(at, prepend=-LEAST - 1) > LEAST]
    at = np.unique(np.r_[0, at, n])
    if (np.diff(at) > MOST).any():
        at = np.unique(np.concatenate([np.arange(a, b, MOST) for a, b in zip(at[:-1], at[1:], strict=True)] + [at]))
    return at


def digests(text: bytes) -> bytes:
    at = cuts(text).tolist()
    return b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)])


def cut(text: bytes, copied: np.ndarray) -> tuple:
    at = cuts(text)
    chunk = np.zeros(len(at) - 1, bool)
    chunk[copied] = True
    edge = np.flatnonzero(np.diff(np.r_[False, chunk, False].astype(np.int8)))
    runs = [(int(at[a]), int(at[b])) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    # a run begins and ends between characters, so that what stays is UTF-8
    runs = [(a, b) for a, b in ((_up(text, a), _down(text, b)) for a, b in runs) if b > a]
    kept, last = [], 0
    for a, b in runs:
        kept.append(text[last:a])
        last = b
    kept = b"".join([*kept, text[last:]])
    return len(text), len(chunk), int(chunk.sum()), len(text) - len(kept), len(runs), sha256(kept).hexdigest(), kept.decode()


def _up(text: bytes, i: int) -> int:
    while i < len(text) and text[i] & 0xC0 == 0x80:
        i += 1
    return i


def _down(text: bytes, i: int) -> int:
    while 0 < i < len(text) and text[i] & 0xC0 == 0x80:
        i -= 1
    return i


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_copied_chunks, n_removed (bytes), n_spans, kept_sha256 and the remaining text."""
    return applied(texts(docs), digests, cut, RESULT, RESULT_SCHEMA, keep=("doc_id",))


#: DuckDB: the same rows as dedup_chunks() where ids are unique; bytes as hexadecimal digits, chunks compared as a whole.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
m0 AS (SELECT b, (b + 1)::UHUGEINT * 13787848793156543929 % 18446744073709551616 AS x FROM range(256) AS t(b)),
m1 AS (SELECT b, xor(x, x >> 27) * 10723151780598845931 % 18446744073709551616 AS x FROM m0),
gear AS (SELECT printf('%02X', b) AS c, (xor(x, x >> 31) >> 32)::BIGINT AS g FROM m1),
q AS (SELECT doc_id, q, substring(h, 2 * q + 1, 1024) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 512)) AS q FROM d)),
y AS (SELECT doc_id, q + i + 1 AS p, substring(part, 2 * i + 1, 2) AS c FROM (SELECT doc_id, q, part, unnest(range(0, length(part) // 2)) AS i FROM q)),
h0 AS (SELECT doc_id, p, g AS v FROM y JOIN gear USING (c)),
h1 AS (SELECT doc_id, p, (v + 2 * lag(v, 1, 0) OVER o) % 4294967296 AS v FROM h0 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
h2 AS (SELECT doc_id, p, (v + 4 * lag(v, 2, 0) OVER o) % 4294967296 AS v FROM h1 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
h3 AS (SELECT doc_id, p, (v + 16 * lag(v, 4, 0) OVER o) % 4294967296 AS v FROM h2 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
h4 AS (SELECT doc_id, p, (v + 256 * lag(v, 8, 0) OVER o) % 4294967296 AS v FROM h3 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
h5 AS (SELECT doc_id, p, (v + 65536 * lag(v, 16, 0) OVER o) % 4294967296 AS v FROM h4 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
u AS (SELECT doc_id, p, p - lag(p, 1, -17) OVER (PARTITION BY doc_id ORDER BY p) AS room FROM h5 WHERE v < 134217728),
l AS (SELECT doc_id, p FROM u WHERE room > 16 UNION SELECT doc_id, 0 FROM d UNION SELECT doc_id, length(h) // 2 FROM d),
e AS (SELECT doc_id, p AS a, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS z FROM l),
c AS (SELECT doc_id, s, least(s + 4096, z) AS z FROM (SELECT doc_id, unnest(range(a, z, 4096)) AS s, z FROM e WHERE z IS NOT NULL)),
x AS (SELECT doc_id, s, z, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1 AS copied
      FROM (SELECT doc_id, s, c.z, substring(h, 2 * s + 1, 2 * (c.z - s)) AS w FROM c JOIN d USING (doc_id))),
i AS (SELECT *, sum((NOT copied)::INTEGER) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM x),
r0 AS (SELECT doc_id, min(s) AS a, max(z) AS z FROM i WHERE copied GROUP BY doc_id, span),
r1 AS (SELECT doc_id, h, a + length(regexp_extract(substring(h, 2 * a + 1, 8), '^([89AB].)*')) // 2 AS a,
       CASE WHEN 2 * z = length(h) THEN z ELSE z - length(regexp_extract(substring(h, 2 * greatest(z - 3, 0) + 1, 2 * (1 + least(z, 3))), '([89AB].)*$')) // 2 END AS z
       FROM r0 JOIN d USING (doc_id)),
k AS (SELECT doc_id, h, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM r1 WHERE z > a),
t AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS n_spans, max(z) AS rest, string_agg(substring(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM k GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (copied) AS n_copied FROM x GROUP BY doc_id),
o AS (SELECT *, unhex(coalesce(kept, '') || substring(h, 2 * coalesce(rest, 0) + 1)) AS left_over FROM d LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_chunks, 0)::INTEGER AS n_chunks, coalesce(n_copied, 0)::INTEGER AS n_copied_chunks,
       coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::INTEGER AS n_spans, sha256(left_over) AS kept_sha256, decode(left_over) AS text
FROM o
"""
