import json
import random

import pytest
from pyspark.sql import functions as F

from emberlog.config import Config
from emberlog.functions import context
from emberlog.operators import delivery, errors, issues, records, restore
from emberlog.sources.tables import nothing, pushed

CFG = Config.resolve(source="app", session_id="s1")


def error_rows(spark, rows):
    """(seq, fingerprint, timestamp)"""
    df = spark.createDataFrame(rows, "seq long, f string, timestamp long")
    none = F.lit(None).cast("string")
    e = F.struct(F.concat(F.lit("b"), "seq").alias("boundary"), none.alias("name"), none.alias("message"), F.col("f").alias("fingerprint"), F.lit(True).alias("handled"), F.lit("error").alias("severity"), none.alias("stack"), none.alias("component_stack"), F.lit(None).cast("array<string>").alias("tags"))
    return df.select("seq", "timestamp", F.lit("error").alias("kind"), e.alias("error"))


def brute(rows, n, w):
    alive, last, counts, fired = {}, {}, {}, []
    for seq, f, t in sorted(rows):
        alive[f] = [x for x in [*alive.get(f, []), t] if x >= t - w]
        counts[seq] = len(alive[f])
        if len(alive[f]) >= n and (f not in last or t - last[f] >= w):
            last[f] = t
            fired.append(seq)
    return counts, fired


@pytest.mark.parametrize("seed", range(3))
def test_counts_and_triggers_in_any_order(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("abc"), r.randrange(0, 400, 5)) for i in range(150)]
    counts, fired = brute(rows, 3, 50)
    got = issues.folded_counts(error_rows(spark, rows), 50)
    assert {x.seq: x.cnt for x in got.collect()} == counts
    assert sorted(x.seq for x in issues.triggers(got, 3, 50).collect()) == fired
    ordered = [(i, f, t) for i, (t, f) in enumerate(sorted((t, f) for _, f, t in rows))]
    counts, fired = brute(ordered, 3, 50)
    got = issues.window_counts(error_rows(spark, ordered), 50)
    assert {x.seq: x.cnt for x in got.collect()} == counts
    assert sorted(x.seq for x in issues.triggers(got, 3, 50).collect()) == fired


def test_late_alerts_of_one_seq(spark):
    rows = [(0, "a", 0), (1, "a", 900), (1, "a", 5000), (2, "a", 5100), (2, "a", 5100), (3, "b", 5), (3, "b", 5)]
    cfg = Config.resolve(source="app", errors={"threshold_count": 2, "threshold_window_ms": 1000})
    # of seq 1 both fire, each once; b's two equal ones are one alert whose count is 2
    got = issues.trigger_rows(error_rows(spark, rows), cfg, in_order=False)
    assert sorted((x.seq, x.fired_at, x.report["fingerprint"], x.report["count"]) for x in got.collect()) == [(1, 900, "a", 2), (1, 5000, "a", 2), (3, 5, "b", 2)]


def test_window_is_inclusive_and_cooldown_ends(spark):
    rows = [(0, "a", 0), (1, "a", 50), (2, "a", 50), (3, "a", 99), (4, "a", 100)]
    got = issues.window_counts(error_rows(spark, rows), 50)
    assert {x.seq: x.cnt for x in got.collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 4: 4}
    assert sorted(x.seq for x in issues.triggers(got, 2, 50).collect()) == [1, 4]


def test_reports(spark):
    rows = [(0, "a", 100), (1, "b", 100), (2, "b", 120), (3, "a", 120), (4, "c", 10), (5, "a", 5)]
    got = issues.ranked(issues.issue_reports(error_rows(spark, rows), 50, 130)).collect()
    # the late last arrival gives the sample though it is outside the window; c has nothing in it
    assert [(x.fingerprint, x["count"], x.first_seen, x.last_seen, x.boundary) for x in got] == [("a", 2, 100, 120, "b5"), ("b", 2, 100, 120, "b2")]


def test_seeded(spark):
    old, new = error_rows(spark, [(0, "a", 0), (1, "a", 1)]), error_rows(spark, [(2, "a", 2), (3, "a", 3)])
    cfg = Config.resolve(source="app", errors={"threshold_count": 3, "threshold_window_ms": 1000})
    assert [x.seq for x in issues.seeded_triggers(old, new, cfg).collect()] == [2]


def test_events(spark):
    rows = [{"component": "c", "action": "a", "timestamp": 5, "context": '{"x":1}'}, {"component": "c", "action": "b", "kind": "error", "request_id": "  ", "channel": "frontend"}]
    got = records.normalize_events(pushed(spark, rows), CFG, now_ms=9).orderBy("seq").collect()
    assert [(r.kind, r.channel, r.runtime, r.timestamp, r.request_id, r.error) for r in got] == [("interaction", "backend", "server", 5, None, None), ("error", "frontend", "server", 9, None, None)]
    assert [json.loads(r.context) for r in got] == [{"x": 1, "analyticsChannel": "backend", "analyticsRuntime": "server"}, {"analyticsChannel": "frontend", "analyticsRuntime": "server"}]
    assert got[0].id.startswith("event_") and got[0].id != got[1].id
    quiet = Config.resolve(source="app", inject_channel_context=False, default_context={"x": 0, "y": 2})
    assert records.normalize_events(pushed(spark, rows), quiet, now_ms=9).orderBy("seq").first().context == '{"x":1,"y":2}'
    assert records.normalize_events(nothing(spark), CFG).count() == 0


def test_error_records(spark):
    rows = [{"boundary": "  Box ", "error": {"name": "TypeError", "message": "for a@b.cc", "stack": "TypeError: for a@b.cc\n at x"}, "handled": False, "severity": "fatal", "context": '{"userId":"u1","errorHandled":"mine"}', "tags": ["t", "t"]}, {"boundary": "", "raw": "oops"}, {}]
    got = errors.errors_to_records(pushed(spark, rows, reports=True), CFG, now_ms=7).orderBy("seq").collect()
    a, b, c = got
    assert (a.component, a.action, a.label, a.error.message, a.error.stack) == ("Box", "unhandled_error", a.error.fingerprint, "for [REDACTED]", "TypeError: for [REDACTED]\nat x")
    ctx = json.loads(a.context)
    assert ctx["userId"] == "[REDACTED]" and ctx["errorHandled"] is False and ctx["errorTags"] == ["t"]
    assert ctx["clientIdentity"]["sessionIdHash"].startswith("hash_") and ctx["clientIdentity"]["identifiers"][0]["key"] == "userId"
    assert (b.component, b.error.name, b.error.message, b.action) == ("UnknownErrorBoundary", "Error", "oops", "error_boundary_caught")
    assert (c.error.name, c.error.message) == ("UnknownError", "Unknown error")


def test_gates(spark):
    r = pushed(spark, [{"boundary": "b"}], reports=True)
    closed = Config.resolve(source="a", endpoint="http://far.example")
    assert errors.gated(r, closed).count() == 0
    assert errors.gated(r, Config.resolve(previous=closed, errors={"secure_endpoint_only": False})).count() == 1
    assert errors.gated(r, Config.resolve(source="a", errors={"enabled": False})).count() == 0


def test_queue_and_envelopes(spark):
    rows = [{"component": "c", "action": x} for x in "abcde"]
    r = records.normalize_events(pushed(spark, rows), CFG, now_ms=1).withColumn("queue_key", F.lit("q"))
    assert sorted(x.action for x in delivery.queue_cap(r, 2).collect()) == ["d", "e"]
    e = delivery.envelopes(delivery.cut_batches(r, 2), CFG, 99).orderBy("batch_no").collect()
    assert [x.n_events for x in e] == [2, 2, 1]
    body = json.loads(e[0].body)
    assert (body["source"], body["sentAt"], [x["action"] for x in body["events"]]) == ("app", 99, ["a", "b"])
    assert "label" not in body["events"][0] and body["events"][0]["sessionId"] == "s1"


def test_admission(spark):
    df = spark.createDataFrame([(0, "error"), (0, "interaction"), (1, "interaction")], "b int, kind string")
    ok = lambda url, only: [r.admitted for r in delivery.admission(df, F.lit(url), only, ["b"]).orderBy("b").collect()]
    assert ok("http://far.example", True) == [False, True] and ok("http://far.example", False) == [True, True] and ok("", True) == [True, True]


def test_restore(spark):
    full = {"id": "1", "component": "c", "action": "a", "source": "s", "sessionId": "x", "timestamp": 5, "context": "text", "extra": 1}
    stored = [{"id": 1}, full, {**full, "timestamp": "5"}, {**full, "id": "2", "channel": "odd", "kind": "error", "context": {"b": 1, "a": None}, "error": {"boundary": "B", "name": "N", "message": "M", "fingerprint": "fp"}}, 3, None]
    df = spark.createDataFrame([(json.dumps(stored),), ("{}",), ("[",), (None,)], "value string")
    got = restore.restore_queue(df, CFG).orderBy("pos").collect()
    assert [(r.id, r.channel, r.runtime, r.kind, r.context) for r in got] == [("1", "backend", "server", "interaction", "{}"), ("2", "backend", "server", "error", '{"b":1,"a":null}')]
    assert got[1].error.fingerprint == "fp" and got[0].error is None


def test_queue_round_trip(spark):
    rows = [{"component": "c", "action": x, "context": '{"b":2,"a":null}'} for x in "ab"]
    r = records.normalize_events(pushed(spark, rows), CFG, now_ms=1).withColumn("queue_key", F.lit("q"))
    back = restore.restore_queue(restore.persist_queue(r), CFG).orderBy("pos").collect()
    assert [(x.action, x.timestamp) for x in back] == [("a", 1), ("b", 1)] and json.loads(back[0].context)["a"] is None


def test_channels_are_escaped(spark):
    rows = [{"component": "c", "action": "a", "timestamp": 5, "context": '{"x":1}', "channel": 'a"b\\c\n'}]
    got = records.normalize_events(pushed(spark, rows), CFG, now_ms=9).first()
    assert json.loads(got.context) == {"x": 1, "analyticsChannel": 'a"b\\c\n', "analyticsRuntime": "server"}


def test_merged_numbers_are_plain(spark):
    given = [("1.0", "1"), ("1e2", "100"), ("1.5", "1.5"), ("1e7", "10000000"), ("12345678.25", "12345678.25"), ("1.5e10", "15000000000"), ("-2.5e20", "-250000000000000000000"), ("1e21", "1e+21"), ("1.25e-7", "1.25e-7"), ("1e-5", "0.00001"), ("-0.0", "0"), ('[1.0,{"b":2e1}]', '[1,{"b":20}]'), ('"1.0 and 1.0E7 \\\\" "'.replace('\\\\"', '\\"'), '"1.0 and 1.0E7 \\" "'), ("true", "true"), ("null", "null")]
    df = spark.createDataFrame([(f'{{"n":{a}}}',) for a, _ in given], "c string")
    got = [r[0] for r in df.select(context.merge_json(F.lit('{"k":1.0}'), F.col("c"))).collect()]
    assert got == [f'{{"k":1,"n":{b}}}' for _, b in given]


def test_long_texts_in_merged_contexts(spark):
    long = '\\"a' * 50_000 + "b" * 200_000
    got = spark.createDataFrame([(f'{{"n":2.0e1,"t":"{long}"}}',)], "c string").select(context.merge_json(F.lit("{}"), F.col("c"))).first()[0]
    assert got == f'{{"n":20,"t":"{long}"}}'
