import json

import pytest
from pyspark.sql import functions as F

from emberlog.config import Config
from emberlog.operators import issues, records
from emberlog.sources.tables import pushed
from emberlog.streaming import delivery
from emberlog.streaming.callbacks import ThresholdConsumer, on_threshold, trigger_reports
from emberlog.streaming.issues import issue_stream
from tests.test_operators import error_rows


def run(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], 13 * i % 200) for i in range(40)]
    df = error_rows(spark, rows)
    for k in range(4):
        df.where((F.col("seq") >= 10 * k) & (F.col("seq") < 10 * k + 10)).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run(issue_stream(stream, 3, 60), "issue_rows", tmp_path)
    got = {(r.seq, r.cnt, r.fired) for r in spark.sql("select * from issue_rows").collect()}
    counts = issues.folded_counts(df, 60)
    fired = {r.seq for r in issues.triggers(counts, 3, 60).collect()}
    assert got == {(r.seq, r.cnt, r.seq in fired) for r in counts.collect()} and fired


def test_fired_rows_call_back_once(spark, tmp_path):
    df = error_rows(spark, [(i, "ab"[i % 2], i) for i in range(12)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    called, failed = [], []

    def callback(row):
        called.append((row["fingerprint"], row["seq"]))
        if row["fingerprint"] == "b":
            raise RuntimeError("not now")

    on_threshold(issue_stream(stream, 3, 60), callback, str(tmp_path / "fired"), str(tmp_path / "cp"), failed.append, availableNow=True).awaitTermination()
    assert called == [("a", 4), ("b", 5)] and [str(e) for e in failed] == ["not now"]
    # the same micro-batch once more, as after a crash
    again = ThresholdConsumer(callback, str(tmp_path / "fired"))
    batch = spark.read.parquet(str(tmp_path / "fired" / "batch_id=0"))
    again(batch, 0)
    assert len(called) == 2
    again(batch, 7)
    assert called[2:] == [("a", 4), ("b", 5)]
    reports = trigger_reports(batch, df, Config.resolve(source="app", errors={"threshold_count": 3})).orderBy("seq").collect()
    assert [(r.source, r.threshold_count, r.report["fingerprint"], r.report["count"], r.report["boundary"]) for r in reports] == [("app", 3, "a", 3, "b4"), ("app", 3, "b", 3, "b5")]


def test_restored_errors_are_counted_and_never_fire(spark, tmp_path):
    old = [(i, "ab"[i % 3 == 0], t) for i, t in enumerate([100, 500, 90, 120, 130, 95, 140, 150])]  # 500 comes before the others
    new = [(20, "a", 151), (21, "b", 152), (22, "a", 160), (23, "c", 160), (24, "b", 700)]
    df = error_rows(spark, new)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(issue_stream(stream, 3, 60, restored=error_rows(spark, old)), "seeded_rows", tmp_path)
    got = {r.seq: (r.cnt, r.fired) for r in spark.sql("select * from seeded_rows").collect()}
    alive, last, want = {}, {}, {}
    for seq, f, t in old + new:
        alive[f] = [x for x in [*alive.get(f, []), t] if x >= t - 60]
        if seq >= 20:
            ok = len(alive[f]) >= 3 and (f not in last or t - last[f] >= 60)
            last[f] = t if ok else last.get(f, -1000)
            want[seq] = (len(alive[f]), ok)
    assert got == want and any(x[1] for x in want.values())


def test_delivery(spark, tmp_path):
    cfg = Config.resolve(source="app", session_id="s", batch_size=2, endpoint="https://in.example", transport=Post(str(tmp_path / "sent")))
    (tmp_path / "sent").mkdir()
    rows = records.normalize_events(pushed(spark, [{"component": "c", "action": x} for x in "abc"]), cfg, now_ms=1).withColumn("queue_key", F.lit("q"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    delivery.deliver(stream, cfg, str(tmp_path / "cp"), clock=lambda: 5, drain=True).awaitTermination()
    sent = sorted([e["action"] for e in json.loads(f.read_text())["events"]] for f in (tmp_path / "sent").iterdir())
    assert sent == [["a", "b"], ["c"]]


def test_refused_envelopes_come_back(spark):
    cfg = Config.resolve(source="app", session_id="s", endpoint="http://far.example", transport=Post("/nowhere"))
    rows = records.normalize_events(pushed(spark, [{"component": "c", "action": "x", "kind": "error"}]), cfg, now_ms=1).withColumn("queue_key", F.lit("q"))
    assert delivery.send_batch(rows, cfg, 5).count() == 1


class Post:
    """A transport that writes a file per envelope."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, request):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(request["body"])


def test_delivery_needs_an_endpoint_and_a_place_for_what_is_refused(spark, tmp_path):
    rows = records.normalize_events(pushed(spark, [{"component": "c", "action": "x", "kind": "error"}]), Config.resolve(source="app", session_id="s"), now_ms=1).withColumn("queue_key", F.lit("q"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for endpoint in (None, "http://far.example"):
        with pytest.raises(ValueError, match="deliver_queues"):
            delivery.deliver(stream, Config.resolve(source="app", endpoint=endpoint), str(tmp_path / "cp"), clock=lambda: 5)
    cfg = Config.resolve(source="app", endpoint="http://far.example", transport=Post("/nowhere"))
    delivery.deliver(stream, cfg, str(tmp_path / "cp"), clock=lambda: 5, drain=True, dead_letters=str(tmp_path / "dead")).awaitTermination()
    assert [(r.batch_id, r.n_events) for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [(0, 1)]
