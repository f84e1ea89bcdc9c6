import random

import pytest

from emberlog.operators import issues
from emberlog.operators.panes import IssuePanes
from tests.test_operators import error_rows


@pytest.mark.parametrize("seed", range(2))
def test_reports_at_any_time(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("abcde"), r.randrange(0, 3000)) for i in range(300)]
    store = IssuePanes(spark, str(tmp_path / "store"), 37)
    for k in (2, 0, 1):  # batches in any order
        store.add(error_rows(spark, rows[100 * k : 100 * k + 100]), k)
    store.add(error_rows(spark, rows[:100]), 0)  # one comes again
    df = error_rows(spark, rows)
    for window, as_of in ((500, 3000), (37, 2999), (1, 3001), (0, 2999), (5000, 4000)):
        want = sorted(map(repr, issues.issue_reports(df, window, as_of).collect()))
        assert sorted(map(repr, store.reports(window, as_of).collect())) == want
    packed = store.compact()
    assert sorted(map(repr, packed.reports(500, 3000).collect())) == sorted(map(repr, issues.issue_reports(df, 500, 3000).collect()))
    assert packed.expire(3000 - 500) > 0
    assert sorted(map(repr, packed.reports(500, 3000).collect())) == sorted(map(repr, issues.issue_reports(df, 500, 3000).collect()))


def test_an_empty_store(spark, tmp_path):
    store = IssuePanes(spark, str(tmp_path / "store"))
    assert store.reports(100, 1000).count() == 0
    store.add(error_rows(spark, [(1, "a", 5)]).limit(0), 0)
    assert store.reports(100, 1000).count() == 0 and store.expire(10**9) == 0


def test_a_stream_keeps_a_store(spark, tmp_path):
    df = error_rows(spark, [(i, "ab"[i % 2], 10 * i) for i in range(30)])
    for k in range(2):
        df.where(f"seq % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    store = IssuePanes(spark, str(tmp_path / "store"), 50)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(store.add).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(repr, store.reports(120, 300).collect())) == sorted(map(repr, issues.issue_reports(df, 120, 300).collect()))


def test_only_the_window_is_read(spark, tmp_path):
    store = IssuePanes(spark, str(tmp_path / "store"), 10)
    store.add(error_rows(spark, [(i, "a", 100 * i) for i in range(100)]), 0)
    plan = store.reports(500, 10_000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "slot" in plan
