"""Decontamination, packing, fingerprints, token files, toxicity, archives and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import decontaminate, minhash, packing, token_ids, toxicity, warc, wavelet, winnow
from emberlog.llm.common import tokenizer_path
from tests.llm.fixtures import DOCUMENTS, documents, empty, key, prose


def test_decontamination(spark):
    docs = documents(spark, [(1, "So then Alice bought 12 apples and 3 pears for 5 dollars at the small market near home."), (2, "Yes. So then Bob bought 99 apples and 7 pears for 8 dollars at the small market near home, ok"), (3, "So then Bob bought 9 apples and 9 pears for 9 dollars at the small market near home"), (4, None), (5, ""), (6, "SO THEN ALICE BOUGHT 12 APPLES AND 3 PEARS FOR 5 DOLLARS AT THE SMALL MARKET NEAR HOME!"), (7, "what is this"), (8, prose(300, 3)), (None, "So then Alice bought 12 apples and 3 pears for 5 dollars at the small market near home.")])
    items = spark.createDataFrame([(7, "So then Alice bought 12 apples and 3 pears for 5 dollars at the small market near home."), (8, "What is this?"), (9, "a b"), (10, None), (None, "x y z")], "item_id long, text string")
    for most in (decontaminate.MOST, 0):
        got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontaminate.contamination(docs, items, most).collect()}
        assert got == {1: (True, [7]), 2: (True, [7]), 3: (True, [7]), 4: (False, []), 5: (False, []), 6: (True, [7]), 7: (True, [8]), 8: (False, []), None: (True, [7])}
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 8]
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.contamination(empty(spark), items).count() == 0


def test_a_clash_parts_an_alignment(spark):
    """Equal values of an item that become different ones, and values merged with a number beside the copy."""
    far = "then Bob counted every one of the boxes again before supper while nobody at home was watching the road"
    items = spark.createDataFrame([(1, f"there were 3 apples with 3 pears on it and {far}"), (2, "5 apples lay beside the old wooden table and then 5 more came in a basket"), (3, "the old wooden table held plums and a basket held 7 more beside number 7")], "item_id long, text string")
    rows = [(1, f"there were 4 apples with 6 pears on it and {far}"), (2, "Q12: 5 apples lay beside the old wooden table and then 5 more came in a basket"), (3, "the old wooden table held plums and a basket held 7 more beside number 7 8 of us left"), (4, "1. 9 apples lay beside the old wooden table and then 9 more came in a basket"), (5, prose(60, 4))]
    got = {r.doc_id: r.item_ids for r in decontaminate.contamination(documents(spark, rows), items).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [2], 5: []}


def test_items_without_windows(spark):
    """Short items and items of numbers and units are found as they are, and not with other numbers."""
    runs = " ".join(f"{k} km {k} kg" for k in range(30, 60))
    items = spark.createDataFrame([(1, "Solve 3x + 5 = 20"), (2, "4, 8, 15, 16, 23"), (3, runs), (4, "x"), (5, "?!"), (6, "")], "item_id long, text string")
    rows = [(1, "7. solve 3X+5=20, 9 of them"), (2, "solve 3x + 5 = 201"), (3, "a 3 4 8 15 16 23 42"), (4, f"so {runs}. And {runs}"), (5, runs.replace("59", "60")), (6, "an x in it"), (7, "?!"), (8, ""), (9, "4, 8, 15"), (10, "16, 23")]
    for most in (decontaminate.MOST, 0):
        got = {r.doc_id: (r.item_ids, r.n_windows) for r in decontaminate.contamination(documents(spark, rows), items, most).collect()}
        assert got == {i: ([], 0) for i in (2, 5, 7, 8, 9, 10)} | {1: ([1], 1), 3: ([2], 1), 4: ([3], 1), 6: ([4], 1)}


def test_longest_run():
    run = decontaminate.longest_run
    assert run([], []) == 0 and run([[], []], [[], []]) == 2
    assert run([[1], [1], [1], [2]], [[5], [6], [6], [7]]) == 3  # the first clashes with the second
    assert run([[1], [1, 1], [1]], [[5], [5, 6], [6]]) == 1  # the one between clashes in itself
    assert run([[1], [2], [3]], [[5], [5], [6]]) == 3  # two values of the item became one


def plain_template(text, names):
    """(kind, word or placeholder, fillers) of a text's tokens, by regular expressions."""
    import re

    found = [(m[0].lower() if m[0].isascii() else "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in m[0]), m) for m in re.finditer("[0-9A-Za-z\u0080-\U0010ffff]+", text)]
    out, before = [], None
    for k, (low, m) in enumerate(found):
        number = bool(re.search("[0-9]", m[0])) or low in decontaminate.NUMBERS.split()
        inside = k > 0 and not re.search(r"[.!?:\n]", text[found[k - 1][1].end() : m.start()])
        kind = decontaminate.NAME if names and inside and re.match("[A-ZÀ-Þ]", m[0]) and re.search("[a-z]", m[0]) else 0
        if number:
            kind = decontaminate.NUMBER
        elif k and before and low in decontaminate.UNITS.split():
            kind = decontaminate.UNIT
        if kind and out and out[-1][0] == kind:
            out[-1][2].append(low)
        else:
            out.append((kind, f"<{kind}>" if kind else low, [low] if kind else None))
        before = number
    return out, [low for low, _ in found]


def plain_windows(tokens, size):
    return [a for a in range(len(tokens) - size + 1) if 2 * sum(t[0] == 0 for t in tokens[a : a + size]) >= size]


def brute_leaks(docs, items):
    """Items of every document: all alignments, and all runs of windows of each."""
    found = {i: set() for i, _ in docs}
    for doc, text in docs:
        for item, question in items:
            last = []
            for names in (True, False):
                (own, said), (asked, words) = plain_template(text, names), plain_template(question, names)
                size, last = min(decontaminate.W, len(asked)), []
                if size < decontaminate.LEAST_WORDS:
                    continue
                last, lines = plain_windows(asked, size), {}
                for a in last:
                    for b in plain_windows(own, size):
                        if [t[1] for t in asked[a : a + size]] == [t[1] for t in own[b : b + size]]:
                            pairs = [(tuple(x[2]), tuple(y[2]), k in (0, size - 1)) for k, (x, y) in enumerate(zip(asked[a : a + size], own[b : b + size], strict=True)) if x[0]]
                            lines.setdefault(b - a, []).append([(x, y) for x, y, edge in pairs if not edge or len(x) == len(y)])
                for line in lines.values():
                    for i in range(len(line)):
                        for j in range(i + 1, len(line) + 1):
                            pairs = {p for w in line[i:j] for p in w}
                            if len({x for x, _ in pairs}) == len(pairs) and j - i >= min(2, len(last)):
                                found[doc].add(item)
            if len(last) < 2 and words and any(said[k : k + len(words)] == words for k in range(len(said))):
                found[doc].add(item)
    return {i: sorted(x) for i, x in found.items()}


def test_leaks_against_brute_force(spark):
    rng, items, rows = random.Random(11), [], []
    for i in range(12):
        words = prose(rng.choice([2, 5, 9, 14, 40]), 300 + i).split()
        for _ in range(len(words) // 4):
            words.insert(rng.randrange(len(words)), rng.choice(["12", "7", "three", "Alice", "Bob", "5 km", "Élan", "9 hours"]))
        items.append((i, " ".join(words) + rng.choice(["?", ".", ""])))
    for i in range(90):
        words = rng.choice(items)[1].split()
        a = rng.randrange(len(words)) if i % 3 == 0 else 0
        words = words[a : a + rng.randrange(3, 60)]
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(words))
            words[k] = rng.choice(["12", "8", "Carol", "zeta", "4"])
        rows.append((i, rng.choice(["", "Q12: ", "5 ", "So "]) + " ".join(words) + rng.choice(["", " 8 more", " and Dan", ". " + prose(12, i)])))
    want = brute_leaks(rows, items)
    table = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.MOST, 0):
        assert {r.doc_id: r.item_ids for r in decontaminate.contamination(documents(spark, rows), table, most).collect()} == want
    assert 20 < sum(map(bool, want.values())) < 90


def test_questions_with_other_values(spark):
    long = "then Bob counted every one of the boxes again before supper while nobody at home was watching the road"
    items = spark.createDataFrame([(1, f"there were 12 apples and then 12 more came in and {long} with 30 of them"), (2, "a bag holds 3 red and 4 blue balls and one is drawn without looking what is its colour")], "item_id long, text string")
    rows = [(1, f"there were 12 apples and then 11 more came in and {long} with 30 of them"), (2, "a bag holds 5 red and 5 blue balls and one is drawn without looking what is its colour"), (3, "a bag holds balls and one is red"), (4, "there were apples and a bag of balls"), (5, f"we saw that {' '.join(long.split()[:6])} and left")]
    assert {r.doc_id: r.item_ids for r in decontaminate.contamination(documents(spark, rows), items).collect()} == {1: [1], 2: [2], 3: [], 4: [], 5: []}


def test_large_benchmarks_are_not_broadcast(spark):
    items = spark.createDataFrame([(1, prose(40, 1) + " 5 apples")], "item_id long, text string")
    docs = documents(spark, [(1, prose(40, 1) + " 5 apples")]).selectExpr("doc_id as id", "doc_id as uid", "text")
    for limits in ((0, 1 << 20), (1 << 20, 10)):
        df = decontaminate.matches(docs, items, *limits)
        assert [r.item_id for r in df.collect()] == [1] and "strategy=broadcast" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in decontaminate.matches(docs, items)._jdf.queryExecution().optimizedPlan().toString()


def reference_ids(name, texts, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


ODD = ["", "a  b", " x", "x ", "a\n\nb", "a\n b", "a \nb", "it's, don't. I'll", "  ", "\n", "É.\nÀ!", "İstanbul ΣΑΣ, ΟΔΟΣ.", "tab\tx, y", "12,5. 3.", "<|endoftext|> x.", "a b", "ﬁ x́, é.", "| a|b |", "x y z"]


@pytest.mark.parametrize("stage", ["hits", "places", "sketches", "sets"])
def test_workers_hold_little_of_a_large_batch(stage):
    import tracemalloc

    import pyarrow as pa

    text = pa.array([prose(400, k % 7) for k in range(3000)])
    key = pa.array(np.arange(len(text)))
    run, columns = {
        "hits": (decontaminate._hits(np.zeros(0, np.uint64), [8]), [key, key, text]),
        "places": (decontaminate._places([8]), [key, key, text]),
        "sketches": (minhash._sketch(5), [key, key, key, text]),
        "sets": (minhash._sets(5), [key, text]),
    }[stage]
    batch = pa.RecordBatch.from_arrays(columns, names=[*"abcd"[: len(columns) - 1], "text"])
    assert batch.nbytes > 4 << 20
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


@pytest.mark.parametrize("name,leading", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunked_ids(name, leading):
    import pyarrow as pa

    texts = ODD + [t or "" for _, t in DOCUMENTS]
    got = token_ids.ChunkEncoder(tokenizer_path(name), leading, most=50).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [x[:-1] for x in reference_ids(name, texts)]


@pytest.mark.parametrize("name,leading", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_are_learned_without_the_signs_after_them(name, leading):
    import os

    import pyarrow as pa

    texts = ["wordone wordone. wordone!!! wordone$%$ wordone\"), wordone's, wordone1. wordoné.", "wordone<| wordone<|endoftext|> <|endoftext|>. wordone|> ...", "... wordone\nwordone. <|startoftext|>wordone>>"]
    encoder = token_ids.ChunkEncoder(tokenizer_path(name), leading)
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [x[:-1] for x in reference_ids(name, texts)]
    assert {x for x in encoder.known if x.startswith("wordone")} == {"wordone", "wordone's", "wordone1.", "wordone<|endoftext|>", "wordone|>"}
    assert set(encoder.tails) == {"", ".", "!!!", "$%$", "\"),", ",", "<|"}
    # a task has one core
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    # where runs of letters can't be told apart by their ids they are joined by a sign
    encoder = token_ids.ChunkEncoder(tokenizer_path(name), leading)
    encoder.ends[:] = True
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [x[:-1] for x in reference_ids(name, texts)]


def test_special_tokens_as_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    for name, leading in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        t = Tokenizer.from_file(tokenizer_path(name))
        t.encode_special_tokens = True
        texts = ["a <|endoftext|> b", "a<|endoftext|>, b", "<|startoftext|>", "x\n<|endoftext|>"]
        got = token_ids.ChunkEncoder(tokenizer_path(name), leading, special_as_text=True).encode(pa.array(texts))
        assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


#: pieces that texts are made of: letters of several scripts whose lower case is longer, marks that join, signs, white space, special tokens
PARTS = [*"abzAZ09.,;:!?'\"|-_$€<>\u0301\u0307\u200b\u00a0\u3000\t\r", *"İıßẞÀéÖñſΣσςЖж中文字ไทยग्हिأبﬁǅ😀👍🏽", " ", " ", " ", "\n", "the", "don't", "I'LL", "<|endoftext|>", "<|startoftext|>", "<|", "12", "İ,", "é.", "i\u0307,"]


@pytest.mark.parametrize("name,leading", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_of_random_texts(name, leading):
    import pyarrow as pa

    rng = random.Random(7)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(1, 14))) for _ in range(20_000)]
    encoder = token_ids.ChunkEncoder(tokenizer_path(name), leading, most=5000)
    got = [x.tolist() for at in range(0, len(texts), 1000) for x in encoder.encode(pa.array(texts[at : at + 1000]))]
    want = [x[:-1] for x in reference_ids(name, texts)]
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_large_ids_are_refused():
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.build(np.array([1, 1 << 16]), 16)


def test_packing(spark):
    rows = packing.pack(documents(spark, clash=True), window=7).collect()
    ids = {}
    for (i, _), x in zip(DOCUMENTS, reference_ids("byte_bpe_50k.json", [t for _, t in DOCUMENTS]), strict=True):
        ids.setdefault(i, []).append(x)
    for r in rows:
        assert any(len(x) >= r.start + r.length and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        assert r.length == 1024 or (r.piece == 0 and r.start == 0)
    total = sum(len(x) for xs in ids.values() for x in xs) + sum(len(ids[DOCUMENTS[k][0]][0]) for k in (0, 2))
    assert sum(r.length for r in rows) == total
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-total // 1024) + 1
    assert packing.pack(empty(spark)).count() == 0


def test_packing_at_any_window(spark, monkeypatch):
    """However the first round is cut, the number of sequences stays near that of one best-fit pass over all pieces."""
    rng = random.Random(11)
    words = "alpha beta gamma delta".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(150, 700)))) for i in range(1500)]
    df = documents(spark, rows, clash=False).repartition(16)
    pieces = None
    for window in (200_000, 100, 10):
        got = packing.pack(df, window=window)
        rows_ = got.collect()
        if pieces is None:
            pieces = len(packing.best_fit(np.array([r.length for r in rows_]), 1024))
        # a task of the first round sees some 90 pieces here, or 10 with the last window
        assert len({r.sequence_id for r in rows_}) <= pieces * (1.03 if window > 10 else 1.06)
        assert sum(r.length for r in rows_) == sum({(r.doc_id, r.piece): r.length for r in rows_}.values())
        ends = {}
        for r in rows_:
            ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in ends.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 1024


def test_patterns_are_best_fit():
    for seed in range(60):
        rng = random.Random(seed)
        limit = rng.choice([10, 100, 1024])
        sizes = np.array([rng.randrange(1, limit + 1) if rng.random() < 0.7 else rng.choice([1, limit // 2, limit // 3]) for _ in range(rng.randrange(1, 400))])
        found = packing.patterns(dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True)), limit)
        assert all(sum(size * n for size, n in held.items()) <= limit and bins > 0 for held, bins in found)
        total = Counter()
        for held, bins in found:
            total.update({size: n * bins for size, n in held.items()})
        assert total == Counter(sizes.tolist())
        assert sum(bins for _, bins in found) == len(packing.best_fit(sizes, limit))


def test_best_fit():
    rng = random.Random(4)
    sizes = np.array([rng.randrange(1, 101) for _ in range(500)])
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sizes[b].sum() <= 100 for b in bins) and len(bins) <= sizes.sum() / 100 * 1.05 + 1


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.zipf(1.5, n) % 49000).astype(np.uint32)
        w = wavelet.WaveletMatrix.build(ids, 16)
        assert (w.decode() == ids).all()
        for i in rng.integers(0, max(n, 1), min(n, 30)).tolist():
            t = int(ids[i])
            assert w.access(i) == t and w.rank(t, i) == int((ids[:i] == t).sum())
            assert w.occurrences(t) == np.flatnonzero(ids == t).tolist() if w.count(t) < 60 else w.select(t, 7) == int(np.flatnonzero(ids == t)[7])
        assert w.count(48_999) == int((ids == 48_999).sum())
        with pytest.raises(IndexError):
            w.select(48_999, n)


def test_token_files(spark):
    got = wavelet.round_trip(documents(spark)).collect()
    rows = sorted(DOCUMENTS + [DOCUMENTS[0], DOCUMENTS[2]], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for (i, _), x in zip(rows, reference_ids("word_bpe_49k.json", [t for _, t in rows]), strict=True):
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert wavelet.round_trip(empty(spark)).count() == 0


def plain_fingerprint(text):
    """hash: first position, of the selected k-grams, by the rolling recurrence and by looking at every window."""
    n, k, w, codes = len(text), winnow.K, winnow.W, [ord(c) for c in text]
    h = 0
    for c in codes[:k]:
        h = (h * winnow.BASE + c) % winnow.PRIME
    values = [h]
    for i in range(n - k):
        h = ((h - codes[i] * pow(winnow.BASE, k - 1, winnow.PRIME)) * winnow.BASE + codes[i + k]) % winnow.PRIME
        values.append(h)
    marks = [(v * winnow.SPREAD >> 31, -i) for i, v in enumerate(values)]
    return sorted({min(marks[j : j + w]) for j in range(max(1, len(marks) - w + 1))}, key=lambda m: -m[1])


def shown(marks):
    return " ".join(f"{(h << 31) + winnow.PRIME + i:X}" for h, i in marks)


EDGES = [(1000 + n, prose(200, 31)[:n]) for n in (0, 1, 3, 4, 5, 11, 12, 13, 26, 27, 28, 29, 35, 36, 37, 39, 40, *range(390, 411, 4))]
SCRIPTS = [(2001, "".join(chr(0x4E00 + 7 * i) for i in range(600))), (2002, "\t".join(prose(150, 8).split())), (2003, "same " * 200), (2004, "😀é" * 150), (2005, "aaaa" * 100)]


def test_fingerprints(spark):
    """Against the rolling recurrence, at every kind of length and script."""
    rows = sorted({(i, t or "") for i, t in DOCUMENTS if i is not None} | set(EDGES) | set(SCRIPTS)) + [(None, "zz")]
    got = {r.doc_id: r for r in winnow.fingerprints(documents(spark, [(i, t or None) for i, t in rows])).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        nxt, m, r = rows[(k + 1) % len(rows)][1], len(t) // 4, got[i]
        edited = t[: len(t) - m] + nxt[:m]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, new, after = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(nxt)
        assert (r.fingerprint, r.edited_fingerprint) == (shown(own), shown(new)), i
        a, b, c = ({h for h, _ in x} for x in (own, new, after))
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-12 and abs(r.near_next - len(a & c) / len(a | c)) < 1e-12
    assert got[1].near_next == 1 and 0.4 < got[15].near_edited < 0.8
    assert winnow.fingerprints(empty(spark)).count() == 0
    one = winnow.fingerprints(documents(spark, [(4, "abcdefgh")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_one_kind_of_tokens_at_all_lengths(spark):
    """A cut at the end, texts without spaces and with tabs: likeness never falls to 0 where most is shared."""
    base = prose(100, 3)
    rows = [(1, base[:399]), (2, base[:401]), (3, base[:409]), (4, "x"), *SCRIPTS[:2]]
    got = {r.doc_id: r for r in winnow.fingerprints(documents(spark, rows)).collect()}
    assert got[1].near_next > 0.9 and got[2].near_next > 0.9
    assert all(got[i].near_edited > 0.4 for i in (1, 2, 3, 2001, 2002))


def test_winnowing_guarantee_and_ties():
    """Every shared stretch of K + W - 1 code points shares a selected k-gram; of equal hashes the rightmost is chosen."""
    a, b = prose(90, 3), prose(40, 4) + prose(90, 3)[100:160] + prose(40, 5)
    x, y = ({h: -i for h, i in plain_fingerprint(t)} for t in (a, b))
    assert x.keys() & y.keys()
    assert [-i for _, i in plain_fingerprint("a" * 100)] == list(range(winnow.W - 1, 100 - winnow.K + 1))
    positions = [-i for _, i in plain_fingerprint(a)]
    assert positions[0] < winnow.W and all(q - p <= winnow.W for p, q in zip(positions, positions[1:], strict=False)) and len(a) - winnow.K - positions[-1] < winnow.W


def test_blocks_of_windows(spark):
    """Texts that end at, before and after the end of a block, with line ends and characters of four bytes in it."""
    b, r = winnow.BLOCK, winnow.REACH
    long = "".join("ab\n\r\u2028😀é\x00 "[i * i * 7 % 11 % 9] + "xyz"[i % 7 % 3] for i in range(300))
    lengths = [b * k + r + x for k in (1, 2) for x in (-1, 0, 1)] + [b, b + 1, 2 * b]
    rows = [(k, long[:n]) for k, n in enumerate(lengths)]
    got = {x.doc_id: x for x in winnow.fingerprints(documents(spark, rows, clash=False)).collect()}
    for k, t in rows:
        m, nxt = len(t) // 4, rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - m] + nxt[:m]
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (shown(plain_fingerprint(t)), shown(plain_fingerprint(edited))), len(t)


def test_code_points_are_compiled(spark):
    """Lambdas, which Spark interprets, see blocks and selected grams but not every code point."""
    plan = winnow.fingerprints(documents(spark, clash=False))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with(" not in plan and "transform(split(" not in plan


def test_buckets_follow_the_ids(spark, monkeypatch):
    """A far id, and ids that are all null, leave the buckets of like size; the next document is right across them."""
    from pyspark.sql import functions as F

    rows = [(i, f"text {i}") for i in range(600)] + [(1 << 61, "far")] + [(None, f"none {i}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", winnow.order_id().alias("id"), winnow.row_key().alias("uid"), "text")
    sizes = [r["count"] for r in winnow.bucketed(d).groupBy("bucket").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 60
    got = {(r.doc_id, r.n_chars): r for r in winnow.fingerprints(d.where("doc_id is not null").drop("id", "uid")).collect()}
    order = sorted(r for r in rows if r[0] is not None)
    for k, (i, t) in enumerate(order):
        nxt, m = order[(k + 1) % len(order)][1], len(t) // 4
        assert got[i, len(t)].edited_sha256 == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
    assert winnow.fingerprints(d.drop("id", "uid")).count() == len(rows)


def test_toxicity(spark):
    bad, rng = ["idiot", "moron", "scum", "trash"], random.Random(1)
    rows, labels = [], []
    for i in range(600):
        words = prose(40, i + 10).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    hidden = [(1000, prose(40, 1) + " you m.o.r.o.n and 1d10t"), (1001, prose(30, 2) + " tr@sh i d i o t " + prose(5, 3)), (1002, prose(40, 5)), (1003, None), (1004, ""), (None, "scum idiot moron trash")]
    lab = spark.createDataFrame([*labels, (5000, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(documents(spark, rows + hidden), lab).collect()}
    assert len(got) == 606 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600)) and not got[None].held_out
    wrong = [i for i, _, t in labels if got[i].held_out and got[i].predicted != t]
    assert len(wrong) <= 2
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 1004, None)] == [1, 1, 0, 0, 0, 1]
    d = documents(spark, rows[:9] + hidden)
    kept = toxicity.without_toxic(d, lab.limit(0))
    assert kept.columns == d.columns and kept.count() == 15
    assert toxicity.score(empty(spark), lab).count() == 0


def test_decoding():
    counts = {}
    for w in ("idiot idiots moron loser stupid trash idle told") .split() * 30:
        w = f"^^{w}$"
        for i in range(len(w) - 2):
            counts[w[i : i + 3]] = counts.get(w[i : i + 3], 0) + 1
    m = toxicity.CharModel(counts)
    assert [toxicity.decode(w, m) for w in ("1d10t", "id-i-ot", "idiooot", "$tup1d", "l0$er")] == ["idiot", "idiot", "idiot", "stupid", "loser"]
    assert not toxicity.disguised("idiot") and toxicity.tokens("I D I O T, ok!") == ["i d i o t", "ok"] and toxicity.restored("i d i o t", m) == "idiot"


def channel(token, model, state="^^", before="", out=""):
    """All readings of a token with their scores, one by one: every letter, sign and repetition that the channel allows."""
    if not token:
        yield model.log_p(state + "$"), out
        return
    c, rest = token[0], token[1:]
    ways = [(c, toxicity.AS_IS)] if c.isalpha() else [*((x, toxicity.LOOKALIKE) for x in toxicity.LOOKS.get(c, "")), ("", toxicity.SEPARATOR if c in toxicity.SEPARATORS else toxicity.SIGN)]
    for x, cost in ways:
        gain = model.log_p(state + x) if x else 0.0
        for score, path in channel(rest, model, (state + x)[-2:], c, out + x):
            yield cost + gain + score, path
    if state[1] == c or (c == before and state[1] in toxicity.LOOKS.get(c, "")):
        for score, path in channel(rest, model, state, c, out):
            yield toxicity.REPEAT / 2 + score, path


def test_decoder_against_all_readings():
    counts = {}
    for w in ("idiot idiots moron loser stupid trash idle told bill glass zoo élan").split() * 30:
        w = f"^^{w}$"
        for i in range(len(w) - 2):
            counts[w[i : i + 3]] = counts.get(w[i : i + 3], 0) + 1
    rng, model = random.Random(5), toxicity.CharModel(counts)
    for _ in range(600):
        token = "".join(rng.choices("idotslé10$@!.-6", k=rng.randrange(1, 9)))
        best = {}
        for score, path in channel(token, model):
            best[path] = max(score, best.get(path, -1e9))
        assert best[toxicity.decode(token, model)] >= max(best.values()) - 1e-9


def test_long_words_and_unspaced_scripts():
    """Costs grow with the length, and no more: words of half a million letters, with and without signs."""
    import base64
    import time

    model = toxicity.CharModel({"^^a": 3})
    for word in (base64.b64encode(random.Random(1).randbytes(400_000)).decode().lower(), "a" * 500_000 + "1b", "a.b" * 170_000, "汉" * 500_000, "汉字，" * 100_000, "." * 500_000 + "a"):
        start = time.perf_counter()
        for t in set(toxicity.tokens(word)):
            assert all(len(f) <= 80 for f in toxicity.features(toxicity.restored(t, model)))
        assert time.perf_counter() - start < 10
    assert toxicity.tokens("汉字文 ab") == ["汉字", "字文", "ab"] and toxicity.tokens("x汉字y, 汉") == ["汉字", "x", "y"]


def test_labels_that_disagree(spark):
    """The toxic one of a document's labels holds, wherever it stands."""
    rows = [(i, prose(20, i) + (" moron scum" if i % 2 else "")) for i in range(300)]
    lab = [(i, i % 2) for i in range(300)]
    more = [(i, 0) for i in range(1, 300, 2)]
    a, b = (toxicity.fit(documents(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (lab, more + lab))
    assert a.weights == b.weights and a.curve == b.curve and "=moron" in a.weights


def test_every_certain_feature_is_kept(spark):
    """No cap and no rank decides what is a feature."""
    import math

    rows = [(i, prose(10, i) + f" tag{chr(97 + i // 20 if i % 2 else 97)}" + (" bad" if i % 2 else "")) for i in range(400)]
    lab = {i: i % 2 for i in range(400) if zlib.crc32(str(i).encode()) % 5}
    scorer = toxicity.fit(documents(spark, rows), spark.createDataFrame(list(lab.items()), "doc_id long, toxic int"))
    got = scorer.weights
    n_pos, pos, neg = sum(lab.values()), {}, {}
    for i, y in lab.items():
        for f in {f for w in set(toxicity.tokens(rows[i][1])) for f in toxicity.features(toxicity.restored(w, scorer.model))}:
            side = pos if y else neg
            side[f] = side.get(f, 0) + 1
    n_neg, want = len(lab) - n_pos, {}
    for f in pos.keys() | neg.keys():
        a, b = pos.get(f, 0) + 0.5, neg.get(f, 0) + 0.5 * n_neg / n_pos
        w = math.log(a / (n_pos + 1)) - math.log(b / (n_neg + 1)) - 2 * math.sqrt(1 / a + 1 / max(b, 1))
        if w > 0:
            want[f] = w
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want) and "=tagd" in got


def test_archives(spark, tmp_path):
    big = "<p>" + "payload " * 200
    inside = big + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" + big
    rows = [(1, "http://a/", big), (2, "http://b/ x\r\ny", big), (3, None, None), (4, "", ""), (5, "u", inside), (6, "u", "short"), (7, "u", "short"), (9, "u", inside), (2, "http://b/", big), (None, "n", big), (10, "é", "é" * 600)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    warc.write(pages, f"file://{tmp_path}/w", per_file=3)
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        top = max((q for q, _, x in rows if (x or "") == (h or "") and q is not None), default=None)
        other = len(raw) >= 1000 and p != top
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other else "response", top if other else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=lambda r: (*key(r[0]), r[1])) == sorted(want, key=lambda r: (*key(r[0]), r[1]))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", "x" * (10 if i % 3 else 40 * i)) for i in range(120)] + [(200, "u", "y" * 9000), (201, "u", "y" * 9000), (202, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w", per_file=100, file_bytes=4000)
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert {(r.page_id, r.payload_bytes, r.refers_to) for r in got} == {(i, len(h or ""), 201 if i == 200 else None) for i, _, h in rows}
    files = {}
    for r in got:
        n, size = files.get(r.file, (0, 0))
        files[r.file] = n + 1, size + (r.payload_bytes if r.record_type == "response" else 0)
    assert all(n == 1 or (n <= 100 and size <= 4000) for n, size in files.values())


def test_only_reachable_records():
    payload = warc.record(2, "u", b"inner", "0" * 40, None, "2024-01-01T00:00:00Z") + warc.END
    data = b"".join(warc.record(i, "u", payload * 2, hashlib.sha1(payload * 2).hexdigest(), None, "2024-01-01T00:00:00Z") + warc.END for i in range(5))
    at, after = warc.candidates(data)
    keep = warc.reachable(at, after)
    assert len(at) == 15 and keep.sum() == 5 and (after[keep][:-1] == at[keep][1:]).all() and after[keep][-1] == len(data)


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "best_fit_packing"]
    docs = p.table(spark, sf, "documents")
    steps = {}
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = p.stored(stage(spark, docs, sf), name)
        steps[name] = docs
        assert docs.columns == before.columns and docs.schema == before.schema
        assert docs.count() <= before.count()
    packed = p.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_queries_are_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()


@pytest.mark.parametrize("name", ["op1_minhash", "op2_line_dedup", "op5_winnowing", "op6_suffix_dedup", "op9_warc", "op10_chunk_dedup", "op12_importance_resampling", "op13_fill_in_middle"])
def test_sql(spark, sf, name):
    import __spark_entry__ as e
    from tests.oracle import connect, same

    assert same(e.queries()[name](spark, sf), connect(sf), e.oracle_sql()[name])
