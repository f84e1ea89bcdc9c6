import random

from pyspark.sql import functions as F

from emberlog.operators import ranks


def test_numbered(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(5), r.choice([None, "a", "b"])) for i in range(997)]
    df = spark.createDataFrame(rows, "i int, x int, s string").repartition(13)
    got = ranks.numbered(df, [F.desc("x"), F.asc_nulls_last("s"), F.asc("i")]).collect()
    want = [x[0] for x in sorted(rows, key=lambda x: (-x[1], x[2] is None, x[2] or "", x[0]))]
    assert [x.i for x in sorted(got, key=lambda x: x.place)] == want and sorted(x.place for x in got) == list(range(997))
    assert ranks.numbered(df.limit(0), [F.asc("i")]).count() == 0


def test_positions(spark):
    r = random.Random(2)
    # one key holds most rows; a null key is a key
    rows = [(q, t) for t, q in enumerate(r.choice(["hot"] * 8 + ["a", "b", None]) for _ in range(2000))]
    df = spark.createDataFrame(rows, "q string, seq long").repartition(7)
    seen, want = {}, {}
    for q, t in rows:
        want[t] = seen.get(q, 0)
        seen[q] = want[t] + 1
    for size in (10, 300, 5000):
        got = ranks.positions(df, ["q"], slice_rows=size)
        assert got.columns == ["q", "seq", "position"] and {x.seq: x.position for x in got.collect()} == want
    assert ranks.positions(df.limit(0), ["q"]).count() == 0


def test_a_hot_key_is_dealt_by_slices(spark):
    df = spark.range(4000).selectExpr("'one' as q", "id as seq")
    points = ranks.split_points(df.select("seq"), "seq", 100)
    sizes = [x["count"] for x in df.groupBy(ranks.slice_of(F.col("seq"), points)).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 200
    low = [p - 1 for p in points[:3]] + points[-1:]
    got = spark.createDataFrame([(x,) for x in low] + [(None,)], "v long").select("v", ranks.slice_of(F.col("v"), points).alias("s")).collect()
    assert [(x.s) for x in got] == [0, 1, 2, len(points), 0]
