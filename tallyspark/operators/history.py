"""Segments of one run against those of an earlier run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_snapshots(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(customer_id, before, after, change) over the customers of both snapshots.

    change: moved | stayed | entered | left. A customer with an empty earlier segment
    counts as stayed.
    """
    before = previous.select("customer_id", F.col("segment").alias("before"),
                             F.lit(True).alias("had"))
    after = current.select("customer_id", F.col("segment").alias("after"),
                           F.lit(True).alias("has"))
    change = (F.when(F.col("had").isNull(), "entered")
               .when(F.col("has").isNull(), "left")
               .when((F.coalesce("before", F.lit("")) != "")
                     & ~F.col("before").eqNullSafe(F.col("after")), "moved")
               .otherwise("stayed"))
    return (before.join(after, "customer_id", "full_outer")
            .select("customer_id", "before", "after", change.alias("change")))


def migration(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(change, from, to, customers): one row per pair of segments customers moved
    between, and one each for entered and left."""
    moved = F.col("change") == "moved"
    counts = (compare_snapshots(previous, current)
              .where(F.col("change") != "stayed")
              .groupBy("change",
                       F.when(moved, F.col("before")).otherwise("").alias("from"),
                       F.when(moved, F.col("after")).otherwise("").alias("to"))
              .agg(F.count(F.lit(1)).alias("customers")))
    return counts.orderBy(F.desc("customers"), "change", "from", "to")
