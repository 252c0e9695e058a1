"""Connected components by alternating large and small stars, over an edge table of longs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from conceptlake.session import cut, drop


def loose(name: str) -> Column:
    """The column without its known partitioning: a join then deals both sides anew, and AQE can split a hub's rows."""
    return F.col(name).bitwiseXOR(F.lit(0).cast("long")).alias(name)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Each round joins every node to the least neighbour (large star: the greater neighbours; small star: the smaller
    ones) until nothing changes, in O(log² n) rounds. Sums and minima are taken before shuffles; rounds are cut by
    tables in the shared scratch folder, each deleted when the next is there, so a lost executor costs at most a round.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(loose("a"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(loose("a"), "m")
        small = large.join(least, "a")
        then = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        drop(now)
        now = then
    raise RuntimeError(f"components did not settle in {rounds} rounds")
