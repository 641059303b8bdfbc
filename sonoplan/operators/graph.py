"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoplan.session import durable, release


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) of each node of the edges (a, b).

    Large-star and small-star steps by turns until nothing changes: a number of rounds logarithmic in the nodes, with never
    more edges than at the start. Each round is kept in the shared folder until the next. Loops and nulls are dropped; no edges, no rows."""
    now = durable(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every edge now points from a larger to a smaller node; equal ones fall together at the end of the round
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        last, now = now, durable(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        release(last)
        after = _state(now)
        if after == before:
            break
        before = after
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
