"""Order-line views over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan with fewer splits than cores, dealt to all cores; a table of many splits
    stays where it is. Filters and columns still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def order_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer and country: the small joins come first, so the line table is
    shuffled at most once, on the order key."""
    return (table(spark, folder, "orders")
            .join(table(spark, folder, "customer"),
                  F.col("o_custkey") == F.col("c_custkey"))
            .join(table(spark, folder, "nation"),
                  F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", "o_custkey", "o_orderstatus",
                    F.col("o_orderdate").cast("timestamp_ntz").alias("order_date"),
                    "c_name", "c_mktsegment", "n_name"))


def lines_tpch(spark: SparkSession, folder: str, returns: bool = False) -> DataFrame:
    """Line items as order lines with product, customer and country; returned lines are
    left out unless asked for."""
    return (_items(spark, folder, returns)
            .join(order_facts(spark, folder), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                *_measures(),
                F.col("p_name").alias("product"),
                F.col("n_name").alias("country"),
                F.col("c_name").alias("customer_name"),
                F.col("p_type").alias("category"),
                F.col("l_partkey").alias("part_key"),
                F.col("l_returnflag").alias("return_flag"),
                F.col("o_orderstatus").alias("order_status"),
                F.col("c_mktsegment").alias("market_segment"),
            ))


def order_lines(spark: SparkSession, folder: str, returns: bool = False) -> DataFrame:
    """The same order lines without the descriptive columns: only the join with the orders
    is left, for everything that needs who, when and how much."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("order_date"))
    return (_items(spark, folder, returns)
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(*_measures()))


def _items(spark, folder, returns):
    items = spread(table(spark, folder, "lineitem"), "l_orderkey")
    return items if returns else items.where(F.col("l_returnflag") != "R")


def _measures():
    return [
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("order_date"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("line_value"),
        F.col("l_linenumber").alias("line_number"),
    ]


def lines_events(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases in the event stream as order lines, one order each, with time of day."""
    return (spread(table(spark, folder, "events"), "event_id")
            .where(F.col("event_type") == "purchase")
            .select(
                F.col("user_id").cast("string").alias("customer_id"),
                F.col("event_id").cast("string").alias("order_id"),
                F.col("ts").cast("timestamp_ntz").alias("order_date"),
                F.lit(1.0).alias("quantity"),
                F.col("value").alias("unit_price"),
                F.col("value").alias("line_value"),
                F.lit("").alias("product"),
                F.lit("").alias("country"),
            ))
