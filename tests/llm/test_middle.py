import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(i, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    u = UNIT.findall(text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (i, len(u), "plain", None, None, sha(text), sha(text))
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (i, len(u), form, len(p), len(m), sha(out), sha(text))


def held(spark, rows):
    got = middle.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(*r)) for r in rows)
    return got


PIECES = ["", " ", "\t\n", "word", "é", "𝔘𝔫", " ", "\x0b", "\x1f", "<", "<P", "P>", "<S", "<M", ">", "a  b", "\r\n", "0"]


def test_edges(spark):
    texts = [None, "", " ", "\n\n", "one", " one", "one ", "a<P>b", "<M>", "<S", "<<P", "x <M y", "Z Z\u0085 Z", "é \U0001f600 f"]
    # ids whose hash asks for a rearrangement, so that the texts decide
    ids = [i for i in range(400) if brute(i, "some words to be cut here")[2] != "plain"][:40]
    rows = [(i, t) for i in ids for t in texts] + [(None, "a b c d"), (None, None), (-5, "a b c"), (ids[0], "one"), (ids[0], "one")]
    assert {r.form for r in held(spark, rows)} == {"plain", "psm", "spm"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=40))
def test_any_text_comes_back(spark, texts):
    held(spark, list(enumerate(texts)))


def test_very_long_texts(spark):
    held(spark, [(i, t) for i in range(6) for t in ("word " * 200_000, " " * 1_000_000, "x" * 1_000_000, "é\n" * 300_000 + " " * 100_000)])


def test_parts_and_clashing_columns(spark):
    d = spark.createDataFrame([(i, "a b c", "mine", 1, "n") for i in range(50)], "doc_id long, text string, units string, a int, form string")
    rows = middle.restore(middle.transform(d, rate=100, spm_rate=50)).collect()
    assert all(r.restored == r.text == r.prefix + r.middle + r.suffix for r in rows) and {r.form for r in rows} == {"psm", "spm"}
    assert {r.form for r in middle.transform(d, rate=0).collect()} == {"plain"}
    assert middle.digests(d.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = middle.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string").where(F.col("doc_id") > 0))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and not re.search("PythonUDF|ArrowEval|MapIn", plan)


@pytest.mark.parametrize("n", [1, 2])
def test_cuts_do_not_depend_on_other_rows(spark, n):
    d = spark.createDataFrame([(7, "a b c d e")] * n, "doc_id long, text string")
    assert {tuple(r) for r in middle.digests(d).collect()} == {brute(7, "a b c d e")}
