"""Connected components of an edge table by alternating star operations.

Each round rewires every node to the least node among its neighbours, from above (large
star) and from below (small star), until nothing changes. The steps are joins and grouped
minima; a node with many neighbours is many rows of a join, never one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is its component's least node.

    Edges with a null end are ignored; an empty table gives an empty table.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state = stage(pairs.groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one"), "edges")
    mark = _mark(state)
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"),
                                                            F.col("m").alias("v"))
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v")
        small = small.groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one")
        after = stage(small, "edges")
        # The same rows again: two sums of row hashes stand for the table.
        before, mark = mark, _mark(after)
        if mark == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                after.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = after


def _mark(pairs: DataFrame) -> tuple:
    half = F.lit(2**31)
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % half),
                           F.sum(F.xxhash64("v", "u") % half)).first())
