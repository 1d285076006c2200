"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """doc_id, component (its smallest doc_id) of every document with an edge.

    edges: a, b. Each step links every node, or its smaller neighbours, to the
    smallest of them; the edges become stars around the smallest ids after a number of steps that
    grows with the logarithm of the longest path. A node's neighbours are only ever
    aggregated, so a hot one needs no task of its own. Every step is written to the
    shared folder.
    """
    now = common.materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.looked_up(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.materialise(large, "edges")
        low = common.looked_up(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        own = large.join(low, "u")
        small = own.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).filter("u <> v").distinct()
        now = common.materialise(small, "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("doc_id"), "component").distinct())
