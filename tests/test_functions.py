import json
import random
import re
import time

import hypothesis
import pytest
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.config import Config, ErrorReporting, backend, frontend, redact_keys
from emberlog.functions import context, hashing, model, text
from emberlog.operators.identity import pseudonym
from emberlog.operators.records import inject_channel, merge_maps

TEXTS = [
    "éjohn@x.com and john@x.com", "BEARER abc.def-1 then bearer tok", "eyJh.eyJz.sig_-x", "12345678 123456789", "198.51.100.10", "www.example.com example.com",
    "/p?token=a b&email=c&x=1#y ?phone=1", "token=abc", "a  b\r\nc\rd\x07e", "", None, "  ", "😀" * 5 + " é", "user@mail.org" + "x" * 300, "﻿ line \n\n\t two ", "ünïcode_123456789", "a" * 238 + " b@c.de",
]


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text_agrees_with_the_model(spark):
    assert column(spark, TEXTS, lambda v: text.single_line(v, 240)) == [model.single_line(t, 240) for t in TEXTS]
    assert column(spark, TEXTS, lambda v: text.multi_line(v, 60)) == [model.multi_line(t, 60) for t in TEXTS]


def test_redaction(spark):
    got = dict(zip(TEXTS, column(spark, TEXTS, lambda v: text.single_line(v, 240)), strict=True))
    # an ASCII word limit lies between é and j
    assert got["éjohn@x.com and john@x.com"] == "é[REDACTED] and [REDACTED]"
    assert got["198.51.100.10"] == "[REDACTED].10"
    assert got["www.example.com example.com"] == "[REDACTED] example.com"
    assert got["12345678 123456789"] == "12345678 [REDACTED]"
    assert got["token=abc"] == "token=abc"
    assert got["BEARER abc.def-1 then bearer tok"] == "Bearer [REDACTED] then Bearer [REDACTED]"
    assert got["/p?token=a b&email=c&x=1#y ?phone=1"] == "/p?token=[REDACTED] b&email=[REDACTED]&x=1#y ?phone=[REDACTED]"
    assert got["a" * 238 + " b@c.de"] == "a" * 238 + " ["  # the mark itself may be cut


#: the five patterns as they are meant, without look-behinds and possessive parts
PLAIN = [
    (r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED]", re.I | re.A),
    (rf"\bBearer{model.SPACE}+[A-Z0-9._-]+\b", "Bearer [REDACTED]", re.I | re.A),
    (r"\b[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "[REDACTED]", re.A),
    (r"\b\d{9,}\b", "[REDACTED]", re.A),
    (rf"([?&](?:token|email|phone|name|user|auth|session|password)=){model.SPACE.replace('[', '[^&#', 1)}*", r"\1[REDACTED]", re.I | re.A),
]


def plain_redact(t):
    for pattern, put, flags in PLAIN:
        t = re.sub(pattern, put, t, flags=flags)
    return t


def test_redaction_of_random_texts(spark):
    rng, parts = random.Random(2), [*"a1_-.%+@ é?&=\n", "@b.co", "x.y", "--", "..", "12345678", "Bearer ", "&token=", "?USER=", "ab"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 16))) for _ in range(6000)]
    want = [plain_redact(t) for t in texts]
    assert [model.redact(t) for t in texts] == want
    assert column(spark, texts, text.redact) == want
    blanks = [rng.choice(["", " ", "\u3000\t", "\ufeff"]) + t + rng.choice(["", "\x85", " \n", "\u2028"]) for t in texts[:300]]
    assert column(spark, blanks, text.trim) == [re.sub(rf"\A{model.SPACE}+|{model.SPACE}+\Z", "", t) for t in blanks] == [model.trim(t) for t in blanks]


@pytest.mark.parametrize("run", ["a-", "-", "a.", "a@", "a.a.", "ab", "9", " ", "a-@", "-.", "Bearer -", "?name=", "x@a.b1", "%", "a\n "])
def test_long_runs_cost_no_more_than_their_length(spark, run):
    long = run * (1_000_000 // len(run))
    start = time.perf_counter()
    got = column(spark, [long, long + "."], lambda v: F.octet_length(F.concat(text.redact(v), text.multi_line(v, 1800), text.single_line(v, 240), text.trim(v))))
    model.single_line(long, 240), model.multi_line(long, 240)
    assert len(got) == 2 and time.perf_counter() - start < 12


def test_hash(spark):
    values = ["", "a", "é", "😀x", "hello world", "日本"]
    want = [model.string_hash(v) for v in values]
    assert want[0] == 0x1505
    assert column(spark, values, hashing.string_hash) == want
    assert column(spark, values, hashing.storage_hash) == [f"hash_{h:x}" for h in want]
    salted = column(spark, ["a"], lambda v: pseudonym(v, "salt"))[0]
    assert salted.startswith("hash_") and len(salted) == 69


def test_tags(spark):
    df = spark.createDataFrame([(1, ["b", " a ", "b", "", "a"] + [f"t{i}" for i in range(12)]), (2, [" ", ""]), (3, None)], "i int, t array<string>")
    got = [r.x for r in df.orderBy("i").select(text.tags(F.col("t"), 10, 240).alias("x")).collect()]
    assert got == [["b", "a", *[f"t{i}" for i in range(8)]], None, None]


@pytest.mark.parametrize(
    "url,ok",
    [("", False), ("  ", False), (None, False), ("/x", True), ("//host/x", False), ("https://a.b", True), ("HTTPS://A.B/x", True), ("http://localhost:1/x", True), ("http://LOCALHOST", True), ("http://127.0.0.1", True), ("http://[::1]:8/", True), ("http://a.b", False), ("http://user@localhost/", True), ("http://localhost.evil.com", False), ("ftp://a.b", False), ("https://", False), ("https://a b", False), ("in/put", True), ("http://localhost:x", False)],
)
def test_secure_endpoint(spark, url, ok):
    assert column(spark, [url], text.secure_endpoint) == [ok]


def test_storage_key(spark):
    assert column(spark, [" My App! ", "", "a.b_c-9"], lambda v: text.storage_key(v, F.lit("backend"))) == ["emberlog.queue.backend.my-app-", "emberlog.queue.backend.unknown-source", "emberlog.queue.backend.a.b_c-9"]


def clean(spark, tree, **limits):
    df = spark.createDataFrame([(tree if isinstance(tree, str) else json.dumps(tree),)], "c string")
    r = df.select(context.clean_tree(F.col("c"), ErrorReporting.resolve(limits)).alias("t")).first().t
    return json.loads(r.context), [(x.key, x.value) for x in r.identifiers]


def test_tree(spark):
    got, found = clean(spark, {"a": {"email": "x@y.zz", "n": [{"token": 5}, {"Authorization": None}]}, "ok": " b  c ", "t": True, "nul": None, "d": 1.5})
    assert got == {"a": {"email": "[REDACTED]", "n": [{"token": "[REDACTED]"}, {"Authorization": "[REDACTED]"}]}, "ok": "b c", "t": True, "nul": None, "d": 1.5}
    assert found == [("a.email", "[REDACTED]"), ("a.n[].token", "5"), ("a.n[].Authorization", "null")]
    assert clean(spark, "[1]") == ({}, []) and clean(spark, "broken") == ({}, [])


def test_depth_and_breadth(spark):
    deep = {"1": {"2": {"3": {"4": {"5": 1}}, "s": "kept"}}}
    assert clean(spark, deep)[0] == {"1": {"2": {"3": {"4": "[truncated]"}, "s": "kept"}}} or clean(spark, deep)[0] == {"1": {"2": {"3": "[truncated]", "s": "kept"}}}
    got, _ = clean(spark, {f"k{i}": i for i in range(21)})
    assert list(got) == [f"k{i}" for i in range(20)]
    assert clean(spark, {"l": list(range(5))}, max_context_breadth=2)[0] == {"l": [0, 1]}


def test_depth_counts_root_entries_as_one(spark):
    tree = {"a": {"b": {"c": {"d": 1}, "x": "s"}}}
    # a: 1, b: 2, c: 3, and an object at 4 is cut
    assert clean(spark, {"a": {"b": {"c": {"d": {"e": 1}, "y": 2}}}})[0] == {"a": {"b": {"c": {"d": "[truncated]", "y": 2}}}}
    assert clean(spark, tree)[0] == tree


def test_circular():
    node = {"email": "a@b.cc"}
    node["self"] = node
    got, found = context.Cleaner(ErrorReporting()).clean({"diagnostics": node})
    assert got == {"diagnostics": {"email": "[REDACTED]", "self": "[circular]"}}
    assert found == [("diagnostics.email", "[REDACTED]")]


def test_channel_injection(spark):
    df = spark.createDataFrame([("{}",), ('{"a":1}',), ('{"analyticsChannel":null}',), ('{ "analyticsRuntime" : "x" }',)], "c string")
    got = [json.loads(r.x) for r in df.select(inject_channel(F.col("c"), F.lit("frontend"), F.lit("browser")).alias("x")).collect()]
    assert got == [{"analyticsChannel": "frontend", "analyticsRuntime": "browser"}, {"a": 1, "analyticsChannel": "frontend", "analyticsRuntime": "browser"}, {"analyticsChannel": None, "analyticsRuntime": "browser"}, {"analyticsRuntime": "x", "analyticsChannel": "frontend"}]


def test_merge_maps(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), ({"a": "1"}, None), (None, {"c": "4"})], "x map<string,string>, y map<string,string>")
        assert [r.m for r in df.select(merge_maps(F.col("x"), F.col("y")).alias("m")).collect()] == [{"a": "1", "b": "3"}, {"a": "1"}, {"c": "4"}]
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")


def test_config():
    with pytest.raises(ValueError):
        Config.resolve(source="  ")
    c = Config.resolve(source=" app ", endpoint=" ", batch_size=0, max_queue_size=2.9, errors={"max_message_length": 1, "threshold_window_ms": 5, "max_tag_count": float("nan")})
    assert (c.source, c.endpoint, c.batch_size, c.max_queue_size) == ("app", None, 20, 2)
    assert (c.errors.max_message_length, c.errors.threshold_window_ms, c.errors.max_tag_count) == (16, 1000, 10)
    assert (c.channel, c.runtime, c.storage_key) == ("backend", "server", "emberlog.queue.backend.app")
    assert frontend(source="x").storage_key == "emberlog.queue.frontend.x" and backend(source="x").runtime == "server"
    d = Config.resolve(previous=c, headers={"x": "1"}, default_context={"a": 1}, endpoint="/in")
    assert d.headers == {"content-type": "application/json", "x": "1"} and d.session_id == c.session_id
    assert Config.resolve(previous=d).endpoint == "/in" and Config.resolve(previous=d, endpoint="").endpoint is None
    assert Config.resolve(previous=d, source="new").storage_key == "emberlog.queue.backend.new"
    assert Config.resolve(previous=Config.resolve(previous=d, storage_key="own"), source="new").storage_key == "own"
    assert redact_keys([" A ", "a", ""]) == ("a",) and len(redact_keys([" "])) == 13


_KEYS = ["a", "b", "user id", "Email", "naïve", "token_x", "", " ", 'q"uote', "1"]
_LEAVES = st.one_of(st.none(), st.booleans(), st.integers(-(10**15), 10**15), st.sampled_from([0.5, 1.5, -2.25, 12345678.5]), st.sampled_from(["", " x  y ", "mail a@b.co now", "\n\t", "null", "12", '{"a":1}', "ü\u00a0😀", 'say "hi" \\\\ there', "x" * 300]))
_TREES = st.dictionaries(st.sampled_from(_KEYS), st.recursive(_LEAVES, lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.sampled_from(_KEYS), x, max_size=4)), max_leaves=12), max_size=5)


@hypothesis.settings(max_examples=6, deadline=None, suppress_health_check=list(hypothesis.HealthCheck))
@hypothesis.given(st.lists(_TREES, min_size=20, max_size=40), st.integers(1, 5), st.integers(1, 4))
def test_trees_against_the_plain_walk(spark, trees, depth, breadth):
    cfg = ErrorReporting.resolve({"max_context_depth": depth, "max_context_breadth": breadth})
    df = spark.createDataFrame([(i, json.dumps(t, ensure_ascii=i % 2 == 0)) for i, t in enumerate(trees)], "i int, c string")
    got = {r.i: (r.t.context, [(x.key, x.value) for x in r.t.identifiers]) for r in df.select("i", context.clean_tree_native(F.col("c"), cfg).alias("t")).collect()}
    for i, t in enumerate(trees):
        tree, found = context.Cleaner(cfg).clean(json.loads(json.dumps(t)))
        assert got[i] == (context.dumps(tree), found), t


def test_no_python_walks_trees(spark):
    df = spark.createDataFrame([('{"a":1}',)], "c string").select(context.clean_tree_native(F.col("c"), ErrorReporting()).alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and df.first().t.context == '{"a":1}'


def test_texts_that_are_no_objects(spark):
    given = [None, "", "null", "[1]", '"x"', "{", '{"a":}', "  {}", '{"a":{}, "b":[]}']
    got = [r.t.context for r in spark.createDataFrame([(x,) for x in given], "c string").select(context.clean_tree_native(F.col("c"), ErrorReporting()).alias("t")).collect()]
    assert got == ["{}"] * 8 + ['{"a":{},"b":[]}']


def test_tags_beyond_the_first_values(spark):
    many = [" "] * 3 + [f" {'x' * (k % 3)}\t" for k in range(200)] + [f"\x07{' ' * k}same" for k in range(60)] + [f"late{k}" for k in range(20)]
    got = spark.createDataFrame([(many,), (many[::-1],), ([None, "a"],)], "t array<string>").select(text.tags(F.col("t"), 5, 240).alias("x")).collect()
    want = lambda values: list(dict.fromkeys(x for x in (model.single_line(v, 240) for v in values) if x))[:5]
    assert [r.x for r in got] == [want(many), want(many[::-1]), ["a"]]
