import json

import pytest
from pyspark.sql import functions as F

from emberlog.config import Config
from emberlog.operators import delivery, restore
from emberlog.sources import envelopes
from tests.test_queues import received, some_records


class Once:
    """A receiver that knows ids; the first try at every second envelope is taken, and then fails as if the task were lost."""

    def __init__(self, folder, flaky=False):
        self.folder, self.flaky = str(folder), flaky

    def __call__(self, request):
        import os

        ident = request["headers"]["idempotency-key"]
        new = not os.path.exists(f"{self.folder}/{ident}.json")
        with open(f"{self.folder}/tries", "a") as f:
            f.write(f"{ident}\n")
        with open(f"{self.folder}/{ident}.json", "w") as f:
            f.write(request["body"])
        if new and self.flaky:
            raise OSError("lost")


def made(spark, n=10, size=2):
    r = some_records(spark, n)
    return r, envelopes.with_ids(delivery.envelopes(delivery.cut_batches(r, size), Config.resolve(source="app", session_id="s"), 7))


def test_batch_and_stream(spark, tmp_path):
    r, rows = made(spark)
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        cfg = Config.resolve(source="app", endpoint="https://in.example", transport=Once(tmp_path / name))
        sink = envelopes.register(spark, cfg, f"sink_{name}", confirm=True)
        if name == "one":
            rows.write.format(sink).mode("append").option("number", "day-1").save()
        else:
            rows.select("envelope_id", "body").write.parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("envelope_id string, body string").parquet(str(tmp_path / "in"))
            stream.writeStream.format(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        got = received(tmp_path / name)
        number = "day-1" if name == "one" else "0"
        assert got.pop(f"confirm-{number}") == {"confirmed": number, "envelopes": 6}
        assert sorted(e["id"] for b in got.values() for e in b["events"]) == sorted(x.id for x in r.select("id").collect())


def test_a_failed_write_sends_the_same_ids_again(spark, tmp_path):
    _, rows = made(spark)
    (tmp_path / "sent").mkdir()
    sink = envelopes.register(spark, Config.resolve(source="app", endpoint="https://in.example", transport=Once(tmp_path / "sent", flaky=True)), "flaky", confirm=True)
    fails = 0
    for _ in range(20):  # each write fails at envelopes that are new to the receiver
        try:
            rows.coalesce(1).write.format(sink).mode("append").save()
            break
        except Exception:
            fails += 1
    got = received(tmp_path / "sent")
    tries = (tmp_path / "sent" / "tries").read_text().split()
    assert fails and len(tries) > len(set(tries)) and set(got) == {x.envelope_id for x in rows.collect()} | {"confirm-0"}
    events = [e["id"] for k, b in got.items() if k != "confirm-0" for e in b["events"]]
    assert len(events) == len(set(events)) == 10


def test_what_a_sink_needs(spark):
    with pytest.raises(ValueError, match="endpoint"):
        envelopes.register(spark, Config.resolve(source="app"))
    cfg = Config.resolve(source="app", endpoint="http://far.example")
    df = spark.createDataFrame([(True,), (False,)], "has_error boolean")
    assert [r.has_error for r in envelopes.admitted(df, cfg).collect()] == [False]
    assert envelopes.admitted(df, Config.resolve(previous=cfg, endpoint="https://far.example")).count() == 2
    sink = envelopes.register(spark, cfg, "strict")
    with pytest.raises(Exception, match="envelopes need"):
        spark.range(1).write.format(sink).mode("append").save()


def test_ids_are_those_of_the_queues(spark):
    from emberlog.streaming.delivery import envelope_id

    _, rows = made(spark)
    assert all(r.envelope_id == envelope_id(r.queue_key, r.first_seq, r.last_seq) for r in rows.collect())


def test_records_round_trip_row_by_row(spark):
    r = some_records(spark, 9, ("a", "b"))
    cfg = Config.resolve(source="app", session_id="s")
    back = restore.restore_records(restore.persist_records(r, 3), cfg)
    assert sorted((x.queue_key, x.pos, x.action) for x in back.collect()) == [("a", 4, "x4"), ("a", 6, "x6"), ("a", 8, "x8"), ("b", 3, "x3"), ("b", 5, "x5"), ("b", 7, "x7")]
    whole = restore.restore_queue(restore.persist_queue(r, most=3), cfg)
    assert [(x.queue_key, x.action) for x in whole.orderBy("queue_key", "pos").collect()] == [("a", "x4"), ("a", "x6"), ("a", "x8"), ("b", "x3"), ("b", "x5"), ("b", "x7")]
    assert json.loads(restore.persist_queue(r.where(F.col("seq") == 0)).first().value)[0]["action"] == "x0"
