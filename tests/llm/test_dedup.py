"""Near-duplicates, lines, suffixes and chunks against brute force."""

import hashlib
import re

import numpy as np
import pytest

from emberlog.llm import chunks, lines, minhash, suffixes
from tests.llm.fixtures import DOCUMENTS, PASSAGE, documents, empty, prose

NULL = (1 << 63) - 1


def shingles(text, size):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_groups(rows, size, percent):
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, size)) for i, t in rows]
    for i, s in sets:
        for j, t in sets:
            if i is not None and j is not None and i < j and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(s), None if i is None else find(i)) for i, s in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = DOCUMENTS + [(100 + i, prose(60, 50) + " " + " ".join(f"w{i}x{k}" for k in range(i % 9))) for i in range(30)]
    got = minhash.near_duplicates(documents(spark, rows), size, 80).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_groups(rows, size, 80)
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_links_across_a_common_hub(spark):
    """b and c are linked with each other, and neither with the smallest document of their band values."""
    base = [f"t{k}" for k in range(100)]
    far = base[:85] + [f"u{k}" for k in range(15)]
    rows = [(1, " ".join(base)), (2, " ".join(far)), (3, " ".join(far[:-2])), (4, " ".join(base[:60] + far[:40]))]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, rows), 2, 80).collect()}
    assert got == brute_groups(rows, 2, 80)


def test_repeated_ids_are_other_documents(spark):
    """An id that stands for a near copy and for an unlike text: the latter is linked with nothing and stays."""
    base = prose(120, 60)
    rows = [(1, base), (2, base + " more"), (2, prose(90, 61)), (3, base + " again"), (3, base + " and again"), (2, base + " more")]
    got = minhash.groups(documents(spark, rows).select("doc_id", "text"), 2, 80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept, r.lead) for r in got) == [(1, 1, True, True), (2, 1, False, False), (2, 1, False, False), (2, 2, True, True), (3, 1, False, False), (3, 1, False, False)]
    assert sorted((r.doc_id, r.text) for r in minhash.without_copies(documents(spark, rows), 2, 80).collect()) == sorted([rows[0], rows[2]])
    twice = [(5, base), (5, base + " more"), (6, base + " again")]
    assert minhash.without_copies(documents(spark, twice), 2, 80).count() == 1
    assert {r.component_id for r in minhash.near_duplicates(documents(spark, twice), 2, 80).collect()} == {5}


def test_blocks_of_a_common_band_value(spark, monkeypatch):
    """Members of one value in several components and blocks, against brute force."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"t{k}" for k in range(100)]
    rows = [(i, " ".join(base[: 100 - 5 * (i % 6)] + [f"u{i % 6}x{k}" for k in range(5 * (i % 6))] + [f"v{i}x{k}" for k in range(i % 3)])) for i in range(40)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, rows, clash=False), 2, 80).collect()}
    assert got == brute_groups(rows, 2, 80)


def test_near_copies_are_caught(spark):
    """Of the documents that a five-word similarity of 0.8 links with a smaller one, the stage's operator misses none."""
    import random

    rng, rows = random.Random(3), []
    for i in range(120):
        words = prose(60 + 7 * (i % 40), 200 + i % 40).split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(999)}"
        rows.append((i, " ".join(words)))
    want = {i for i, _, c in brute_groups(rows, 5, 80) if i == c}
    got = {r.doc_id for r in minhash.without_copies(documents(spark, rows), 5, 80).collect()}
    assert got == want and len(want) < 100


def test_one_of_each_group_stays(spark):
    kept = minhash.without_copies(documents(spark), 5, 80)
    assert kept.columns == documents(spark).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").distinct().where("doc_id is not null").collect()) == sorted({c for i, n, c in brute_groups(DOCUMENTS, 5, 80) if i is not None})


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    a, b = x[:3000], x[600:3600]
    s, t, u = minhash.sketches([a, b, np.union1d(a, b)])
    assert (minhash.merge(s, t) == u).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(minhash.similarity(s[None], t[None], np.array([3000.0]), np.array([3000.0]))[0] - true) < 0.17


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted({(NULL if i is None else i, t or "") for i, t in rows}):
        ls = t.split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            w = "\n".join(ls[k : k + 3])
            if w.strip():
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        out[(i, t)] = (len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone))
    return out


def test_lines(spark):
    got = lines.dedup_lines(documents(spark)).collect()
    want = brute_lines(DOCUMENTS)
    assert len(got) == len(DOCUMENTS) + 2
    assert sorted((NULL if r.doc_id is None else r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == sorted((NULL if i is None else i, *want[(NULL if i is None else i, t or "")]) for i, t in DOCUMENTS + [DOCUMENTS[0], DOCUMENTS[2]])
    by = {r.doc_id: r for r in got}
    assert (by[13].n_removed, by[13].text) == (6, "first here\nlast here")
    assert (by[17].n_removed, by[17].n_spans) == (4, 1)


def test_lines_keep_columns(spark):
    d = documents(spark)
    kept = lines.without_repeats(d)
    assert kept.columns == d.columns and kept.schema == d.schema
    assert {r.doc_id for r in kept.collect()} >= {5, 6, 7, 8}
    copy = documents(spark, [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (3, "x")])
    assert sorted(r.doc_id for r in lines.without_repeats(copy).collect()) == [1, 3]
    blank = documents(spark, [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd\n\t\r\n "), (3, "\t\n")])
    assert sorted(r.doc_id for r in lines.without_repeats(blank).collect()) == [1, 3]


def test_intermediate_tables_are_shared_and_released(spark):
    import os

    from emberlog.llm import common

    path = common.new_path(spark, "x")
    common.stored(spark.range(3), "y").count()
    folder = common.run_dir(spark).removeprefix("file://")
    assert path.startswith(common.run_dir(spark)) and os.listdir(folder)
    common.release(spark)
    assert not os.path.exists(folder)

    class Cluster:
        class sparkContext:
            master = "spark://far:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda k, d: d)

    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster)


def test_names_that_the_operators_use(spark):
    """Columns that begin as helper columns do are kept as they are."""
    d = spark.createDataFrame([(1, "a b c d e f g", "x", "y", "z"), (2, "a b c d e f g", "x", "y", "z")], "doc_id long, text string, _id string, __key string, ___row_key string")
    assert [tuple(r) for r in minhash.without_copies(d, 5, 80).collect()] == [(1, "a b c d e f g", "x", "y", "z")]


@pytest.mark.parametrize("hot", [0, 64])
def test_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = suffixes.spans(documents(spark), block_bytes=500).collect()
    assert len(got) == len(DOCUMENTS) + 2
    least = {}
    rows = [(NULL if i is None else i, (t or "").encode()) for i, t in DOCUMENTS]
    for i, b in rows:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, NULL), i)
    want = set()
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        want.add((i, len(b), bytes(np.frombuffer(b, np.uint8)[~gone])))
    assert {(NULL if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept)) for r in got} == want
    digests = suffixes.dedup_strings(documents(spark)).where("doc_id = 3").first()
    assert digests.n_removed > 300 and digests.n_spans == 1


def test_zero_bytes_and_periods(spark):
    rows = [(1, "\0" * 70 + "abc"), (2, "x" + "\0" * 60), (3, "ab" * 80), (4, "ba" * 40 + "q" + "ab" * 30), (5, "y" * 49), (6, "y" * 49), (7, "y" * 50), (8, "y" * 51)]
    got = {r.doc_id: bytes(r.kept) for r in suffixes.spans(documents(spark, rows), block_bytes=20).collect()}
    assert got == {1: rows[0][1].encode(), 2: b"x", 3: rows[2][1].encode(), 4: b"q", 5: b"y" * 49, 6: b"y" * 49, 7: b"y" * 50, 8: b""}


def test_family_sizes_grow():
    family = suffixes.Family()
    for k in range(33):
        family.add(np.array([f"k{k}".encode() + b"\x01\x01"], suffixes.KEY), np.array([k]))
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == 33 and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_batches_are_scanned_against_the_levels():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(np.frombuffer(b"ab", np.uint8), 90)) for _ in range(6)]
    texts = [b"".join(texts[i] for i in rng.integers(0, 6, 4)) for _ in range(60)]
    family, seen, hits, levels = suffixes.Family(), {}, 0, 0
    for first, end in ((0, 50), (50, 53), (53, 56), (56, 60)):
        part = texts[first:end]
        data, at = np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])
        where, _ = suffixes.anchors(data, at)
        doc = np.searchsorted(at, where, "right") - 1
        level = suffixes.Level(suffixes.contexts(data, at, where, doc), first + doc)
        least = family.scan(level)
        for i, t in enumerate(part):
            for k in range(len(t) - 49):
                seen.setdefault(t[k : k + 50], first + i)
        found = {}
        for key, row in zip(level.keys.view(np.uint8).reshape(-1, suffixes.KEY.itemsize), least.tolist(), strict=True):
            text = bytes(key[50:76][::-1]) + bytes(key[:50])
            for before, got in enumerate(row):
                if before < key[-2] and 50 - before < key[-1]:
                    w = text[26 - before : 76 - before]
                    found[w] = min(found.get(w, got), got)
                else:
                    assert got == suffixes.NONE
        assert all(found[t[k : k + 50]] == seen[t[k : k + 50]] for t in part for k in range(len(t) - 49))
        hits += sum(i < first for i in found.values())
        family.join(level)
        levels = max(levels, len(family.levels))
    assert hits > 1000 and levels > 1


def test_ids_that_cannot_be_parted(spark):
    rows = [(None, prose(80, 1)), (None, prose(80, 1) + " x"), (7, prose(80, 2)), (7, prose(80, 2) + " y"), (7, prose(60, 1))]
    got = {(r.doc_id, r.n_bytes): r.n_bytes - len(r.kept) for r in suffixes.spans(documents(spark, rows), block_bytes=100).collect()}
    for i, t in rows:
        assert (got[i, len(t.encode())] > 300) == (i is None)


def test_chunks(spark):
    rows = DOCUMENTS + [(50, prose(300, 70) + PASSAGE), (51, "shifted " + prose(300, 70) + "! and more " + prose(30, 71))]
    got = {r.doc_id: r for r in chunks.dedup_chunks(documents(spark, rows)).where("doc_id is not null").collect()}
    assert got[1].n_removed == 0 and got[2].text == "" and got[2].n_removed == got[2].n_bytes
    assert got[3].n_removed > 250 and got[4].n_removed > 250 and got[51].n_removed > 1000
    assert got[15].n_removed == 0 or got[15].n_removed < 0.05 * got[15].n_bytes
    for i, t in rows:
        if i is not None:
            assert got[i].kept_sha256 == hashlib.sha256(got[i].text.encode()).hexdigest()
            assert got[i].n_bytes == len((t or "").encode()) == got[i].n_removed + len(got[i].text.encode())


def plain_cuts(text):
    """Chunk limits by a hash that rolls over single bytes."""
    h, marks = 0, []
    for i, c in enumerate(text):
        h = (h << 1) + int(chunks.GEAR[c]) & 0xFFFFFFFF
        if h >> 32 - chunks.BITS == 0:
            marks.append(i + 1)
    marks = [x for k, x in enumerate(marks) if not k or x - marks[k - 1] > chunks.LEAST]
    out = [0]
    for x in sorted({*marks, len(text)} - {0}):
        out += [*range(out[-1] + chunks.MOST, x, chunks.MOST), x]
    return out


def test_chunks_against_brute_force(spark):
    rows = DOCUMENTS + [(60, "äö" * 9000), (61, "q" + "äö" * 9000), (62, "".join(chr(0x4E00 + i * 7 % 900) for i in range(700))), (63, "w" + "".join(chr(0x4E00 + i * 7 % 900) for i in range(50, 700)))]
    got = {(r.doc_id, r.n_chunks, r.n_copied_chunks, r.n_removed, r.n_spans, r.text) for r in chunks.dedup_chunks(documents(spark, rows, clash=False)).where("doc_id is not null").collect()}
    seen, want = set(), set()
    for i, t in sorted((i, (t or "").encode()) for i, t in rows if i is not None):
        at, gone, n = plain_cuts(t), np.zeros(len(t), bool), 0
        for a, b in zip(at, at[1:], strict=False):
            n += t[a:b] in seen
            gone[a:b] = t[a:b] in seen
            seen.add(t[a:b])
        # a run that begins or ends inside a character keeps that character's bytes
        limits, kept, spans = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0])), gone.copy(), 0
        for a, b in zip(limits[::2].tolist(), limits[1::2].tolist(), strict=True):
            while a < len(t) and t[a] & 0xC0 == 0x80:
                kept[a], a = False, a + 1
            while b < len(t) and t[b] & 0xC0 == 0x80:
                kept[b - 1], b = False, b - 1
            spans += b > a
        want.add((i, len(at) - 1, n, int(kept.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~kept]).decode()))
    assert got == want


def test_short_copies_go_whole(spark):
    """Copies under 100 bytes too: a word, a line, a line with other letters, and chunks between unlike neighbours."""
    short = [(1, "one"), (2, "one"), (3, prose(12, 5)), (4, prose(12, 5)), (5, "é ü 😀"), (6, "é ü 😀"), (7, ""), (8, ""), (9, "two")]
    got = {r.doc_id: (r.text, r.n_removed) for r in chunks.dedup_chunks(documents(spark, short, clash=False)).collect()}
    assert len(prose(12, 5)) < 100
    assert got == {i: ("", len(t.encode())) if i in (2, 4, 6) else (t, 0) for i, t in short}
    rows = [(i, f"{prose(9, 20 + i)} {i} {prose(16, 77)} {i} {prose(9, 40 + i)}") for i in range(30)]
    got = {r.doc_id: r.text.encode() for r in chunks.dedup_chunks(documents(spark, rows, clash=False)).collect()}
    seen = set()
    for i, t in rows:
        at, kept = chunks.cuts(t.encode()).tolist(), b""
        for a, b in zip(at, at[1:], strict=False):
            part = t.encode()[a:b]
            kept += b"" if part in seen else part
            seen.add(part)
        assert got[i] == kept


def test_cuts_come_back_after_an_insertion():
    t = prose(2000, 5).encode()
    a, b = set(chunks.cuts(t).tolist()), {x - 7 for x in chunks.cuts(t[:4000] + b"INSERT!" + t[4000:]).tolist()}
    far = {x for x in a if x > 4100}
    assert far and far <= b


@pytest.mark.parametrize("f", [minhash.near_duplicates, lines.dedup_lines, suffixes.dedup_strings, chunks.dedup_chunks])
def test_empty_table(spark, f):
    assert f(empty(spark)).count() == 0
