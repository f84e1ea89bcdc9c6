"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, comp): comp is the smallest node that can be reached.

    Every round takes the smallest label among the neighbours, then the label's own
    label (pointer jumping). Rounds are written to the shared folder.
    """
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    now = stored(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = edges.join(now, edges.v == now.node).groupBy("u").agg(F.min("comp").alias("m"))
        step = now.join(near, now.node == near.u, "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        step = stored(step, "labels")
        up = step.select(F.col("node").alias("at"), F.col("comp").alias("up"))
        new = stored(step.join(up, step.comp == up.at, "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        if new.where("comp <> was").isEmpty():
            return new.select("node", "comp")
        now = new.select("node", "comp")
