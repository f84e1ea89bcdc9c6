import json
import time

from pyspark.sql import functions as F

from emberlog.config import Config
from emberlog.operators import delivery, records
from emberlog.sources.tables import pushed
from emberlog.streaming import callbacks, queues


class Receiver:
    """A transport that writes a file per envelope id; it fails while a file named fail is there."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, request):
        import os

        if os.path.exists(f"{self.folder}/fail"):
            raise OSError("no way")
        name = f"{self.folder}/{request['headers']['idempotency-key']}.json"
        with open(f"{self.folder}/tries", "a") as f:
            f.write("x")
        with open(name, "w") as f:
            f.write(request["body"])


def received(folder):
    return {f.stem: json.loads(f.read_text()) for f in folder.glob("*.json")}


def some_records(spark, n, queues_=("a", "b"), kind=None, start=0):
    rows = [{"component": "c", "action": f"x{i}", "kind": kind} for i in range(start, start + n)]
    r = records.normalize_events(pushed(spark, rows), Config.resolve(source="app", session_id="s"), now_ms=1)
    r = r.withColumns({"seq": F.col("seq") + start, "id": F.concat(F.lit("e"), F.col("seq") + start)})
    return r.withColumn("queue_key", F.element_at(F.array(*map(F.lit, queues_)), (F.col("seq") % len(queues_) + 1).cast("int")))


def feed(df, folder, name):
    df.coalesce(1).write.parquet(str(folder / "in" / name))


def source(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder / "in"))


def run(stream, cfg, folder, until, restored=None):
    """Runs a query until the condition holds and was seen by a whole micro-batch, then stops it; the rows of its log.

    Such a query always has a next micro-batch, which looks for timers that ended.
    """
    q = queues.deliver_queues(stream, cfg, str(folder / "cp"), str(folder / "log"), restored, clock=lambda: 7)
    try:
        wait(q, until)
    finally:
        q.stop()
    return stream.sparkSession.read.schema(queues.LOG).parquet(str(folder / "log")).collect()


def wait(q, until):
    end, seen = time.time() + 60, None
    while time.time() < end and q.isActive:
        batch = (q.lastProgress or {}).get("batchId", -1)
        if seen is None and until():
            seen = batch
        if seen is not None and batch >= seen + 2:
            break
        time.sleep(0.1)
    assert q.exception() is None and until()


def events(folder):
    return sorted((b["sentAt"], [e["action"] for e in b["events"]]) for b in received(folder).values())


def test_queues_equal_the_batch_form_through_a_restart(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    cfg = Config.resolve(source="app", session_id="s", batch_size=3, endpoint="https://in.example", transport=Receiver(tmp_path / "sent"), flush_interval_ms=600_000)
    df = some_records(spark, 23)
    for k in range(3):
        feed(df.where((F.col("seq") >= 8 * k) & (F.col("seq") < 8 * k + 8)), tmp_path, str(k))
    want = {r.queue_key: [] for r in df.select("queue_key").distinct().collect()}
    for r in delivery.envelopes(delivery.cut_batches(df, 3), cfg, 7).orderBy("queue_key", "batch_no").collect():
        want[r.queue_key].append(r)
    full = {queues.envelope_id(q, r.first_seq, r.last_seq): json.loads(r.body) for q, rows in want.items() for r in rows if r.n_events == 3}
    rest = {queues.envelope_id(q, r.first_seq, r.last_seq): json.loads(r.body) for q, rows in want.items() for r in rows if r.n_events < 3}
    stream = source(spark, df, tmp_path)
    quick = Config.resolve(previous=cfg, flush_interval_ms=400)
    from dataclasses import replace

    # the size alone sends whole batches; what is less waits for the interval
    q = queues.delivery_log(stream, cfg, clock=lambda: 7).writeStream.format("parquet").option("path", str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    wait(q, lambda: received(tmp_path / "sent") == full)
    q.stop()
    assert received(tmp_path / "sent") == full and rest
    # after a restart with one more record each, the rest goes with it or by the timer
    more = some_records(spark, 2, start=100)
    feed(more, tmp_path, "late")
    log = run(stream, replace(quick, flush_interval_ms=400), tmp_path, lambda: sum(len(x["events"]) for x in received(tmp_path / "sent").values()) >= 23)
    sent = sorted(e["id"] for b in received(tmp_path / "sent").values() for e in b["events"])
    assert sent[: len(sent)] == sorted(set(sent)) and {r.status for r in log} == {"sent"}


def test_records_wait_for_an_endpoint_and_the_oldest_go(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    none = Config.resolve(source="app", session_id="s", batch_size=2, max_queue_size=5, flush_interval_ms=300)
    df = some_records(spark, 9, ("q",))
    feed(df, tmp_path, "0")
    stream = source(spark, df, tmp_path)
    q = queues.deliver_queues(stream, none, str(tmp_path / "cp"), str(tmp_path / "log"), clock=lambda: 7)
    wait(q, lambda: (q.lastProgress or {}).get("batchId", -1) >= 1)
    q.stop()
    assert not received(tmp_path / "sent")
    cfg = Config.resolve(previous=none, endpoint="https://in.example", transport=Receiver(tmp_path / "sent"))
    run(stream, cfg, tmp_path, lambda: len(received(tmp_path / "sent")) == 3)
    assert events(tmp_path / "sent") == [(7, ["x4", "x5"]), (7, ["x6", "x7"]), (7, ["x8"])]


def test_failures_and_refusals_stay_until_they_can_go(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    (tmp_path / "sent" / "fail").touch()
    cfg = Config.resolve(source="app", session_id="s", batch_size=2, endpoint="http://far.example", transport=Receiver(tmp_path / "sent"), flush_interval_ms=300)
    df = some_records(spark, 4, ("plain", "errors")).withColumn("kind", F.when(F.col("queue_key") == "errors", "error").otherwise("interaction"))
    feed(df, tmp_path, "0")
    stream = source(spark, df, tmp_path)
    tried = lambda: {(r.queue_key, r.status) for r in spark.read.schema(queues.LOG).parquet(str(tmp_path / "log")).collect()} if (tmp_path / "log").exists() else set()
    heard = []
    listener = callbacks.listen(spark, heard.append)
    log = run(stream, cfg, tmp_path, lambda: tried() >= {("plain", "failed"), ("errors", "refused")} and heard)
    spark.streams.removeListener(listener)
    assert all(isinstance(e, callbacks.DeliveryError) for e in heard) and sum(e.failed for e in heard) >= 1 and sum(e.refused for e in heard) >= 1 and any("no way" in str(e) or "https" in str(e) for e in heard)
    assert {(r.queue_key, r.status, r.waiting) for r in log} == {("plain", "failed", 2), ("errors", "refused", 2)} and not received(tmp_path / "sent")
    (tmp_path / "sent" / "fail").unlink()
    run(stream, Config.resolve(previous=cfg, endpoint="https://far.example"), tmp_path, lambda: len(received(tmp_path / "sent")) == 2)
    assert events(tmp_path / "sent") == [(7, ["x0", "x2"]), (7, ["x1", "x3"])]


def test_restored_records_are_sent_first(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    cfg = Config.resolve(source="app", session_id="s", batch_size=2, endpoint="https://in.example", transport=Receiver(tmp_path / "sent"), flush_interval_ms=300)
    df = some_records(spark, 2, ("q",))
    feed(df, tmp_path, "0")
    old = some_records(spark, 3, ("q",), start=50)
    run(source(spark, df, tmp_path), cfg, tmp_path, lambda: sum(len(x["events"]) for x in received(tmp_path / "sent").values()) == 5, restored=old)
    assert [a for _, a in sorted(events(tmp_path / "sent"), key=lambda x: x[1] != ["x50", "x51"])][0] == ["x50", "x51"]
    assert sorted(a for _, x in events(tmp_path / "sent") for a in x) == ["x0", "x1", "x50", "x51", "x52"]
