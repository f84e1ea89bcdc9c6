import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from emberlog.llm import secret_scan as s
from emberlog.llm.common import encoded
from tests.llm.fixtures import documents, empty, prose

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute(text):
    """Kind, start and end of the patterns' spans, read from the text as characters."""
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


TEXTS = [
    None, "", " \n", "no secrets here", "password=hunter22", 'ſecret: "abcdefgh" and SECRET : abcdefgh', "toKen = 'a.b=c/d+e'", "token: token: abcdef", "api_key:abcde", "apikey==abcdefgh", "API_KEY   =   x-y_z.w99",
    "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIAAKIA" + "B7" * 10 + "c", "0" * 23, "é" + "a" * 24 + "g" + "b" * 30, "f" * 60_000, 'the token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" of', "😀 passwd:" + " " * 1000 + "abcdef😀",
    "secret=" + "deadbeef" * 4 + " \x01 " + "tail", "word " * 3000 + "token=abcdef1 " + "word " * 3000,
]


def corpus(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(40, i + 1).split()
        if i % 4 == 0:
            at = r.randrange(len(words))
            words[at:at] = ["token", "=", f'"{hashlib.sha1(str(i).encode()).hexdigest()}"']
        rows.append((1000 + i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4]), (3, TEXTS[3]), (3, TEXTS[4])] + corpus()
    return rows, s.digests(documents(spark, rows)).collect()


def test_patterns_against_brute_force(found):
    rows, got = found
    want = []
    for i, t in rows:
        b = brute(t)
        text = ",".join(":".join(map(str, x)) for x in b)
        want.append(repr((i, *(sum(x[0] == k for x in b) for k in ("assign", "access", "hex")), hashlib.sha256(text.encode()).hexdigest())))
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(want)
    # the patterns' spans are among all spans, in order
    by_id = {i: t for i, t in rows if i is not None and i != 3}
    for r in got:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)
        if r.doc_id in by_id:
            assert [tuple(x) for x in spans if x[0] != "crf"] == [(k, str(a), str(b)) for k, a, b in brute(by_id[r.doc_id])]


def test_other_forms_are_found_and_prose_is_not(spark):
    field = s.fit(s.texts(documents(spark, corpus())))
    secrets = ["ghp_A8f3kQ92LmZx71PqRt0vWyB4nC6d", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "q8Zr1Xw4Lm2Np9Vb7Kd3", "sk-9aB3cD5eF7gH9iJ1kL3mN5oP7qR9sT1u"]
    rows = [(k, f"{prose(12, k + 7)} {x} {prose(12, k + 70)}") for k, x in enumerate(secrets)]
    clean = [(100 + k, prose(60, 5000 + k)) for k in range(60)] + [(200, "see https://www.example.com/some/page of 2024-01-02, call 49-123-456789")]
    got = {r.doc_id: r.spans for r in s.scan(documents(spark, rows + clean), field).collect()}
    assert [[(x.kind, x.text) for x in got[k]] for k in range(4)] == [[("crf", x)] for x in secrets]
    assert [i for i, spans in got.items() if i >= 100 and spans] == []


def test_nothing_to_learn_from(spark):
    assert s.digests(empty(spark)).count() == 0
    rows = s.scan(documents(spark, [(1, "plain words"), (2, "AKIA" + "Z" * 20)]).limit(1)).collect()
    assert [r.spans for r in rows] == [[]]


def test_viterbi_against_all_tags(monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 3)
    r = np.random.default_rng(1)
    for _ in range(150):
        n = int(r.integers(1, 9))
        scores, first, moves = r.normal(size=(n, 3)) * 2, r.random(n) < 0.3, r.normal(size=(3, 3))
        first[0] = True

        def value(tags, scores=scores, first=first, moves=moves):
            if any(t == 2 and (first[k] or tags[k - 1] == 0) for k, t in enumerate(tags)):
                return -np.inf
            return sum(scores[k, t] + (0 if first[k] else moves[tags[k - 1], t]) for k, t in enumerate(tags))

        got = s.viterbi(scores.astype(np.float32), first, moves)
        assert tuple(got) == max(itertools.product(range(3), repeat=n), key=value)


def test_gradient_against_differences():
    r = np.random.default_rng(2)
    scores, tags, there, moves = r.normal(size=(4, 3, 5)), r.integers(0, 3, size=(4, 5)), np.ones((4, 5), bool), r.normal(size=(3, 3))
    there[3, 1] = there[2:, 2] = False
    loss, of_scores, of_moves = s.gradient(scores, tags, there, moves)
    for i in np.ndindex(4, 3, 5):
        other = scores.copy()
        other[i] += 1e-6
        assert abs((s.gradient(other, tags, there, moves)[0] - loss) / 1e-6 - of_scores[i]) < 1e-4
    for i in np.ndindex(3, 3):
        other = moves.copy()
        other[i] += 1e-6
        assert abs((s.gradient(scores, tags, there, other)[0] - loss) / 1e-6 - of_moves[i]) < 1e-4


def test_chains_of_long_texts(monkeypatch):
    monkeypatch.setattr(s, "SECTION", 50)
    import pyarrow as pa

    texts = ["word " * 30, "é" * 80, "", "short", "x" * 130, "a b"]
    data, at = encoded(pa.array(texts))
    groups = [(base, limits.tolist()) for base, limits in s._sections(data, at)]
    limits = [base + x for base, part in groups for x in part]
    assert set(at.tolist()) <= set(limits) and sorted(limits) == limits and limits[-1] == len(data)
    assert all(part[-1] <= 50 or len(part) == 2 for _, part in groups) and max(np.diff(sorted(set(limits)))) <= 50
    for a, b in itertools.pairwise(sorted(set(limits))):
        data[a:b].tobytes().decode()


def test_tokens():
    text = "Ab1.c-d/e, 'x=y': ünï_9 .end a..b z"
    data = np.frombuffer(text.encode(), np.uint8)
    t = s.tokens(data, np.array([0, len(data)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(t.start, t.end, strict=True)] == ["Ab1.c-d/e", "x", "y", "ünï_9", "end", "a", "b", "z"]
    assert (t.x >= np.array(list(s._OFFSETS.values()))).all() and (t.x < np.array([*list(s._OFFSETS.values())[1:], s.N_WEIGHTS])).all()
