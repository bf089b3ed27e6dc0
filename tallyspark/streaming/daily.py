"""Daily sales kept up to date while order lines arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import amount, sum_units


def daily_sales_stream(lines: DataFrame, late_by: str = "2 days") -> DataFrame:
    """(date, revenue, lines) per day over a stream of canonical lines, in any output mode.

    Lines later than ``late_by`` are left out. The state holds one row per open day; distinct
    orders are counted by :func:`daily_orders_stream`.
    """
    timed = lines.withColumn("order_date", F.col("order_date").cast("timestamp"))
    return (timed.withWatermark("order_date", late_by)
            .groupBy(F.window("order_date", "1 day").alias("day"))
            .agg(sum_units(F.col("line_value")).alias("units"),
                 F.count(F.lit(1)).alias("lines"))
            .select(F.to_date("day.start").alias("date"),
                    amount(F.col("units")).alias("revenue"), "lines"))


def daily_orders_stream(lines: DataFrame, late_by: str = "2 days") -> DataFrame:
    """(date, revenue, orders, lines) per day over a stream of canonical lines, in append mode.

    Two stateful steps: lines are added up per day and order, and the orders of a day when it is
    over. The state is keyed by order, so a busy day is spread over the cluster, and both keys go
    once the watermark has passed their day. Lines later than ``late_by`` are left out; a
    :class:`~tallyspark.streaming.ledger.Ledger` keeps and counts them.
    """
    timed = lines.withColumn("order_date", F.col("order_date").cast("timestamp"))
    orders = (timed.withWatermark("order_date", late_by)
              .groupBy(F.window("order_date", "1 day").alias("day"), "order_id")
              .agg(sum_units(F.col("line_value")).alias("units"),
                   F.count(F.lit(1)).alias("lines")))
    return (orders.groupBy(F.window(F.window_time("day"), "1 day").alias("of"))
            .agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("orders"),
                 F.sum("lines").alias("lines"))
            .select(F.to_date("of.start").alias("date"), amount(F.col("units")).alias("revenue"),
                    "orders", "lines"))
