"""Outside daily factors and how they go with revenue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import amount, half_even, sum_units
from ..functions.numbers import plain_number

RESERVED = ("date", "revenue", "orders")


def factor_names(factors: DataFrame) -> list[str]:
    return [c for c in factors.columns if c not in RESERVED]


def combine(daily: DataFrame, factors: DataFrame) -> DataFrame:
    """Daily sales with the factors of the same day; days without factors stay. Both sides
    have one row per day."""
    return daily.join(factors.select("date", *factor_names(factors)), "date", "left")


def matched_days(combined: DataFrame) -> DataFrame:
    """One row (n_days, matched_days): days in the series, and those with any factor."""
    names = factor_names(combined)
    any_factor = (reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in names])
                  if names else F.lit(False))
    return combined.agg(F.count(F.lit(1)).alias("n_days"),
                        F.count_if(any_factor).alias("matched_days"))


def factor_effects(combined: DataFrame, min_days: int = 30) -> DataFrame:
    """One row per factor that can be judged, strongest first (``position``).

    A 0/1 flag with both values gives the revenue lift of its days over the other days in
    percent; any other number gives Pearson's correlation with revenue. Both are rounded
    before ranking; ties go by factor name. All factors are scored in one aggregation.
    """
    def as_number(name):
        kind = combined.schema[name].dataType
        cell = F.col(f"`{name}`")
        return plain_number(cell) if isinstance(kind, T.StringType) else cell.cast("double")

    names = factor_names(combined)
    numbers = combined.select("date", F.col("revenue").cast("double").alias("revenue"),
                              *[as_number(c).alias(c) for c in names])
    value, revenue = F.col("value"), F.col("revenue")
    stats = (numbers.unpivot(["date", "revenue"], [F.col(f"`{c}`") for c in names],
                             "factor", "value")
             .groupBy("factor").agg(
        F.count(F.lit(1)).alias("days"),
        F.count("value").alias("known"),
        F.count_if(value == 1).alias("on_days"),
        F.count_if(value == 0).alias("off_days"),
        sum_units(F.when(value == 1, revenue)).alias("on_units"),
        sum_units(F.when(value == 0, revenue)).alias("off_units"),
        (F.min("value") < F.max("value")).alias("varies"),
        F.try_divide(F.covar_pop("value", "revenue"),
                     F.stddev_pop("value") * F.stddev_pop(F.when(value.isNotNull(), revenue)))
        .alias("r")))
    avg_on = F.try_divide(amount(F.col("on_units")), F.col("on_days"))
    avg_off = F.try_divide(amount(F.col("off_units")), F.col("off_days"))
    is_flag = ((F.col("on_days") + F.col("off_days") == F.col("known"))
               & (F.col("on_days") > 0) & (F.col("off_days") > 0))
    usable = F.when(is_flag, (F.col("on_days") >= 3) & (F.col("off_days") >= 3)
                    & (avg_off != 0)).otherwise(F.col("varies") & F.col("r").isNotNull())
    lift = F.try_divide(avg_on - avg_off, avg_off) * 100
    judged = (stats.where((F.col("days") >= min_days) & (F.col("known") >= min_days) & usable)
              .select(
        "factor",
        F.when(is_flag, "flag").otherwise("numeric").alias("type"),
        F.when(is_flag, half_even(lift, 1)).alias("effect_pct"),
        F.when(~is_flag, half_even(F.col("r"), 3)).alias("correlation"),
        F.when(is_flag, F.col("on_days")).alias("on_days"),
        F.when(is_flag, half_even(avg_on, 2)).alias("avg_on"),
        F.when(is_flag, half_even(avg_off, 2)).alias("avg_off"),
        F.when(F.when(is_flag, lift).otherwise(F.col("r")) >= 0, "raises")
         .otherwise("lowers").alias("direction"),
        F.when(~is_flag, F.when(F.abs("r") >= 0.5, "strong")
               .when(F.abs("r") >= 0.3, "moderate").otherwise("weak")).alias("strength")))
    strength = F.abs(F.coalesce("effect_pct", F.col("correlation") * 100))
    # One row per factor column of a table header: small enough to rank in one task.
    return judged.withColumn("position", F.row_number().over(
        Window.orderBy(strength.desc(), "factor")))

