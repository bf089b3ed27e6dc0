"""Salted joins give the rows of plain ones, and no task a hot key by itself."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.hot_join import hot_join, hot_keys


def tables(spark, n=6000):
    left = spark.range(n).select(
        F.col("id").alias("line"), F.when(F.col("id") % 3 == 0, 7).when(
            F.col("id") % 50 == 1, None).otherwise(F.col("id") % 900).alias("k"),
        F.lit("left").alias("salt"))
    right = spark.range(800).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    return left, right.unionByName(right.where("k = 7 or k = 8").withColumn("twice", F.lit(-1)))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(spark, how):
    left, right = tables(spark)
    assert 0 < len(hot_keys(left, ["k"], 16)) < 5
    got, want = hot_join(left, right, ["k"], how, tasks=16), left.join(right, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_no_hot_key_no_salt(spark):
    left = spark.range(1000).select(F.col("id").alias("k"))
    assert hot_keys(left, ["k"], 8) == {}
    assert hot_join(left.where("false"), left, ["k"]).collect() == []
    with pytest.raises(ValueError):
        hot_join(left, left, ["k"], "full")


def test_tasks_are_even_without_adaptive_execution(spark):
    """A third of the rows has one key; no task gets over twice the median of rows."""
    left, right = tables(spark, 60_000)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get(
        "spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = sorted(r["count"] for r in hot_join(left, right.dropDuplicates(["k"]), ["k"])
                      .groupBy(F.spark_partition_id().alias("task")).count().collect())
        plain = sorted(r["count"] for r in left.join(right.dropDuplicates(["k"]), ["k"], "left")
                       .groupBy(F.spark_partition_id().alias("task")).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[2])
    assert sum(rows) == 60_000
    assert rows[-1] <= 2 * rows[len(rows) // 2] < plain[-1]
