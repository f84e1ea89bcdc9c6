"""Places in an order without one task that holds all rows, or all rows of a key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: rows of a slice of positions(), and the most slices (the split points are one array of the driver)
SLICE_ROWS, MOST_SLICES = 1_000_000, 10_000

_LOW = (1 << 33) - 1  # monotonically_increasing_id: the row's number in its partition


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with ``name``: 0, 1, 2 and so on in the given order.

    The rows are sorted by range partitions and stored with their number in their partition; the partitions' counts,
    one row each, give what comes before. Rows that are equal in the order come in any order.
    """
    kept = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    return kept.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOW))).drop("_part", "_at", "_before")


def split_points(df: DataFrame, order: str, slice_rows: int = SLICE_ROWS) -> list:
    """Values that part the rows in slices of about slice_rows in the order of a numeric column."""
    rows = df.count()
    n = min(MOST_SLICES, math.ceil(rows / slice_rows))
    if n < 2:
        return []
    points = df.agg(F.percentile_approx(order, F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(10 * n))).first()[0] or []
    return sorted(set(points))


def slice_of(value: Column, points: list) -> Column:
    """How many points are at most value: looked up in two steps of about the root of their number. Nulls are in slice 0."""
    if not points:
        return F.lit(0)
    width = math.ceil(math.sqrt(len(points)))
    groups = [points[k : k + width] for k in range(0, len(points), width)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    tables = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    g = F.size(F.filter(heads, lambda x: x <= value))
    inside = F.size(F.filter(F.get(tables, g - 1), lambda x: x <= value))
    return F.when(value.isNull() | (g == 0), 0).otherwise((g - 1) * width + inside)


def positions(df: DataFrame, keys: list[str], order: str = "seq", name: str = "position", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """df with ``name``: every row's place (from 0) among the rows of its keys, in the order of a numeric column.

    The order is cut in slices of about slice_rows rows; rows are dealt by keys and slice, so one key with all
    rows goes to as many tasks as there are slices. The counts of (keys, slice), which are aggregated before they are
    shuffled, give what comes before. Rows that are equal in keys and order come in any order and stay in one slice.
    """
    points = split_points(df.select(order), order, slice_rows)
    if not points:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long") - 1)
    # a struct is equal to one with the same nulls, so the join keeps the dealing of the window
    cut = df.withColumns({"_key": F.struct(*keys), "_slice": slice_of(F.col(order), points)})
    counts = cut.groupBy("_key", "_slice").agg(F.count("*").alias("_n"))
    before = counts.select("_key", "_slice", (F.sum("_n").over(Window.partitionBy("_key").orderBy("_slice")) - F.col("_n")).alias("_before"))
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy("_key", "_slice").orderBy(order)) - 1)
    return own.join(before, ["_key", "_slice"]).withColumn(name, F.col("_before") + F.col("_own")).select(*df.columns, name)
