"""WARC archives: pages are written as records and read back by boundary-chain verification.

Writing: a page becomes an HTTP response record. Of records with equal payloads of
``least`` bytes or more, that with the largest page_id is the response, and the others
are revisit records without a payload. Spark's text writer puts the CR LF CR LF after
each record. Files are gzip-compressed and hold ``per_file`` records and ``file_bytes`` of payload at most (or one record), for which pages are
written by classes of size; offsets count bytes of the archive inside.

Reading: the marker ``WARC/1.1`` may also stand inside a payload. Every marker in a file
is a candidate with a successor offset (the end of the record that it would begin). Pointer jumping
from the start of the file marks the candidates that can be reached; only those are records.

Nulls: null html is the empty payload, a null url becomes about:blank, a null page_id
stays null and never wins as response over a page with an id. Repeated rows are written as
often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, pieces_of

MARK = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"
RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])


def record(page: int | None, url: str | None, html: bytes, digest: str, refers: int | None, date: str) -> bytes:
    """One record without the CR LF CR LF that ends it."""
    uri = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "about:blank").encode()) or b"about:blank"
    name = "" if page is None else str(page)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    head = [f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        html = b""
    block = http + html
    return MARK + "\r\n".join(head).encode() + b"\r\nWARC-Target-URI: " + uri + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block


def _records(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, column="html"):
                rows = zip(*(c.to_pylist() for c in part.columns), strict=True)
                made = [record(p, u, h.encode(), d, r, date).decode() for p, u, h, d, r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])

    return run


def _classes(per_file: int, file_bytes: int) -> list[tuple[int, int | None, int]]:
    """(from, below, records in a file) of the sizes of payloads."""
    out, low = [], 0
    while per_file > 1:
        out.append((low, max(low, file_bytes // per_file), per_file))
        low, per_file = out[-1][1], per_file // 64
    return [*out, (low, None, 1)]


def write(pages: DataFrame, path: str, least: int = 1000, per_file: int = 4000, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> None:
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    n, digest = F.octet_length("html"), F.sha1(F.col("html").cast("binary")).alias("digest")
    # one row per digest: partial maxima are made before the shuffle
    best = p.where(n >= least).select("page_id", digest).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers")
    kinds = _classes(per_file, file_bytes)
    held = [(n >= low) if high is None else (n >= low) & (n < high) for low, high, _ in kinds]
    used = p.agg(*[F.count_if(h).alias(f"n{k}") for k, h in enumerate(held)]).first()
    for k, (low, high, records) in enumerate(kinds):
        if k and not used[k]:
            continue
        own = p.where(held[k])
        # payloads that are too short for revisits aren't shuffled
        out = own.where(n >= least).select("*", digest).join(best, "digest", "left").select("page_id", "url", "html", "digest", refers)
        if low < least:
            out = out.unionAll(own.where(n < least).select("page_id", "url", "html", digest, F.lit(None).cast("long")))
        out = out.mapInArrow(_records(date), "value string")
        out.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).option("compression", "gzip").text(f"{path}/size-{k}")


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all markers and the offset after the record that each would begin (-1: none)."""
    at = [m.start() for m in re.finditer(re.escape(MARK), data)]
    after = []
    for a in at:
        head = data.find(END, a)
        m = re.search(rb"\r\nContent-Length: (\d{1,15})\r\n", data[a : head + 2]) if head >= 0 else None
        end = head + 4 + int(m[1]) if m else -1
        after.append(end + 4 if m and data[end : end + 4] == END else -1)
    return np.array(at, np.int64), np.array(after, np.int64)


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates lie on the chain from offset 0, by pointer jumping."""
    n = len(at)
    seen = np.zeros(n + 1, bool)
    if not n or at[0] != 0:
        return seen[:n]
    found = np.minimum(np.searchsorted(at, after), n - 1)
    jump = np.r_[np.where(at[found] == after, found, n), n]  # n: the chain's end
    seen[0] = True
    for _ in range(int(n).bit_length() + 1):
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
    return seen[:n]


def parse(data: bytes, a: int, end: int) -> tuple:
    head = data.find(END, a)
    fields = dict(x.split(b": ", 1) for x in data[a + len(MARK) : head].split(b"\r\n"))
    block = data[head + 4 : end - 4]
    http, _, payload = block.partition(END)
    revisit = fields[b"WARC-Type"] == b"revisit"
    ident = lambda k: int(v) if (v := fields[k][len(b"<urn:page:") : -1]) else None
    n = int(re.search(rb"Content-Length: (\d+)", http)[1]) if revisit else len(payload)
    digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    if not revisit and sha1(payload).hexdigest() != digest:
        raise ValueError(f"the record at {a} doesn't match its digest")
    return ident(b"WARC-Record-ID"), fields[b"WARC-Target-URI"].decode(), n, digest, fields[b"WARC-Type"].decode(), ident(b"WARC-Refers-To") if revisit else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            name, data = batch.column(0)[k].as_py(), gzip.decompress(batch.column(1)[k].as_py())
            at, after = candidates(data)
            keep = reachable(at, after)
            rows = [(*parse(data, a, e), name, a) for a, e in zip(at[keep].tolist(), after[keep].tolist(), strict=True)]
            if len(data) and (not rows or after[keep][-1] != len(data)):
                raise ValueError(f"{name}: the chain of records doesn't end with the file")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RECORD_SCHEMA)], schema=RECORD_SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, file, offset of every record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(_read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB: the same rows as round_trip().
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to
FROM q
"""
