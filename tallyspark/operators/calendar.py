"""Daily and monthly sales, and the calendar-normalised seasonality index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import amount, half_even, sum_units
from ..schema import MONTHS


def distinct_orders_per(lines: DataFrame, period: Column) -> DataFrame:
    """(period, revenue, orders): orders are counted once per period in two steps, so a
    busy period is spread over its orders before it is counted."""
    return (lines.groupBy(period.alias("period"), "order_id")
            .agg(sum_units(F.col("line_value")).alias("units"))
            .groupBy("period")
            .agg(amount(F.sum("units")).alias("revenue"), F.count(F.lit(1)).alias("orders")))


def daily_sales(lines: DataFrame) -> DataFrame:
    """(date, revenue, orders) for the days with sales; no customer data."""
    return (distinct_orders_per(lines, F.to_date("order_date"))
            .withColumnRenamed("period", "date"))


def monthly_curve(lines: DataFrame) -> DataFrame:
    """(month, revenue, orders) for every month from the first to the last, empty ones 0."""
    month = F.trunc("order_date", "month")
    sales = distinct_orders_per(lines, month)
    calendar = (sales.agg(F.min("period").alias("a"), F.max("period").alias("b"))
                .select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("period")))
    return (calendar.join(sales, "period", "left")
            .select(F.date_format("period", "yyyy-MM").alias("month"),
                    F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
                    F.coalesce("orders", F.lit(0).cast("long")).alias("orders")))


def month_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), number)


def seasonality_index(lines: DataFrame) -> DataFrame:
    """(month_num, month, index): revenue per calendar day of each month of the year,
    100 = the mean month.

    Calendar days, not days with sales, are counted between the first and last date. One
    aggregation reads the lines; everything after it has at most twelve rows, or one row
    per calendar day of the span.
    """
    by_month = lines.groupBy(F.month("order_date").alias("month_num")).agg(
        sum_units(F.col("line_value")).alias("units"),
        F.min(F.to_date("order_date")).alias("first"),
        F.max(F.to_date("order_date")).alias("last"))
    exposure = (by_month.agg(F.min("first").alias("a"), F.max("last").alias("b"))
                .select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("d"))
                .groupBy(F.month("d").alias("month_num"))
                .agg(F.count(F.lit(1)).alias("days")))
    rate = (exposure.join(by_month, "month_num", "left")
            .select("month_num",
                    (F.coalesce(amount(F.col("units")), F.lit(0.0)) / F.col("days"))
                    .alias("rate")))
    mean = F.avg("rate").over(Window.partitionBy()
                              .orderBy("month_num")
                              .rowsBetween(Window.unboundedPreceding,
                                           Window.unboundedFollowing))
    return rate.select(
        "month_num",
        month_name(F.col("month_num")).alias("month"),
        half_even(F.try_divide(F.col("rate"), mean) * 100, 0).cast("int").alias("index"))


def peak_and_low(index: DataFrame) -> DataFrame:
    """The month that sells most and the one that sells least, the earlier one on ties."""
    top = F.max_by(F.struct("month", "index"),
                   F.struct(F.col("index"), (-F.col("month_num")).alias("m")))
    low = F.min_by(F.struct("month", "index"), F.struct("index", "month_num"))
    return (index.agg(top.alias("t"), low.alias("l"))
            .select(F.col("t.month").alias("peak_month"),
                    F.col("t.index").alias("peak_index"),
                    (F.col("t.index") - 100).alias("peak_uplift_pct"),
                    F.col("l.month").alias("low_month"),
                    F.col("l.index").alias("low_index")))
