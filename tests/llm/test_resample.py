import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import resample
from tests.llm.fixtures import documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def counted(text, longest_run, buckets):
    w = words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + r]).encode()) % buckets for r in range(1, longest_run + 1) for i in range(len(w) - r + 1))


def brute(docs, target, percent=10, least=20, longest_run=1, buckets=10_000):
    per = [counted(t, longest_run, buckets) for _, t in docs]
    s, t = sum(per, Counter()), sum((counted(x, longest_run, buckets) for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    g = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    rows = []
    for k, ((i, text), c) in enumerate(zip(docs, per, strict=True)):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(n * g[b] for b, n in c.items())
        rows.append([i, sum(c.values()), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, k, len(words(text)) >= least])
    able = sorted((r for r in rows if r[6]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return rows


def held(spark, docs, target, **more):
    d = documents(spark, docs)
    b = spark.createDataFrame([(k, x, "s") for k, x in enumerate(target)], "item_id long, text string, slice string")
    got = resample.resample(d, b, **more).collect()
    # rows that are equal but for their place may change places
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(repr(tuple(r[:4])) for r in brute(docs, target, **{"least" if k == "least_words" else k: v for k, v in more.items()}))
    pick = lambda rows: sorted((r[4], r[0] is None, r[0], r[3]) for r in rows if r[4] is not None)
    assert pick(got) == pick(brute(docs, target, **{"least" if k == "least_words" else k: v for k, v in more.items()}))
    return got


EDGES = [(1, None), (2, ""), (3, " .,\n"), (4, "one"), (5, "ONE two"), (6, "élan Ünï 😀 42a"), (None, "null id here"), (None, None), (7, "same text"), (7, "same text"), (-1, "x" * 5000 + " y"), (8, "a" * 48 + " " + "b" * 49)]


@pytest.mark.parametrize("longest_run,buckets", [(1, 10_000), (2, 97), (3, 10_000)])
def test_against_brute_force(spark, monkeypatch, longest_run, buckets):
    monkeypatch.setattr(resample, "PART_SLICES", 1)  # so that ranges are split
    r = random.Random(longest_run)
    vocabulary = [f"w{k}" for k in range(40)] + ["the"] * 40
    docs = EDGES + [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(60)))) for i in range(100, 300)]
    target = [" ".join(r.choice(vocabulary[:20]) for _ in range(30)) for _ in range(20)] + [None, ""]
    got = held(spark, docs, target, percent=30, least_words=5, longest_run=longest_run, buckets=buckets)
    assert sum(x.rank is not None for x in got) > 30


def test_empty_tables(spark):
    assert resample.resample(empty(spark), empty(spark)).count() == 0
    held(spark, [(i, "w " * 25 + str(i)) for i in range(30)], [])
    held(spark, [(1, None), (2, "a")], ["a"])


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(resample, "SLICE_BYTES", 1000)
    texts = [(1, "word other " * 3000), (2, "x" * 10_000), (3, ("y" * 2500 + " z ") * 5), (4, "é" * 3001 + " end")]
    low = np.frombuffer(texts[2][1].encode(), np.uint8)
    assert b"".join(p.tobytes() for p in resample._parts(low)) == texts[2][1].encode()
    for _, text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        n, total, bucket, _, counts = resample._counted(data, np.array([0, len(data)]), 1, 10_000)
        assert dict(zip(bucket.tolist(), counts.tolist(), strict=True)) == counted(text, 1, 10_000) and n[0] == total[0] == len(words(text))


def test_crc32s():
    r = random.Random(5)
    data = bytes(r.randrange(256) for _ in range(4000))
    start = np.array([r.randrange(3900) for _ in range(500)])
    end = start + np.array([r.choice([0, 1, 2, 5, 47, 48, 49, 90]) for _ in range(500)])
    got = resample.crc32s(np.frombuffer(data, np.uint8), start, end)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
