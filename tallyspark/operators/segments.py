"""Quintile scores, the five named segments and their profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import grand_total, half_even, units
from ..functions.order_stats import Found, Wanted, find_ranks
from ..schema import SEGMENTS

QUINTILES = (1, 2, 3, 4)


def quintile_cuts(df: DataFrame, columns: list[str]) -> dict[str, list[Found]]:
    """What is needed to score: the value at each fifth of every column, and its ties."""
    wanted = [Wanted(c, q / 5.0, lambda n, q=q: -(-n * q // 5))
              for c in columns for q in QUINTILES]
    found = find_ranks(df, wanted)
    return {c: found[i * 4:i * 4 + 4] for i, c in enumerate(columns)}


def quintile(value: Column, cuts: list[Found], reverse: bool = False) -> Column:
    """Score 1..5 = ceil(5 x average rank / n); equal values share a score.

    The score grows with the value, so it is 1 plus the number of cuts passed. A cut is
    passed by larger values; by its own value only when the average rank of the tie lies
    above the fifth (integer arithmetic, doubled to keep halves).
    """
    score = F.lit(1)
    for q, cut in zip(QUINTILES, cuts):
        if not cut.n:
            continue
        tie_passes = 5 * (2 * cut.below + cut.equal + 1) > 2 * q * cut.n
        passed = value >= cut.value if tie_passes else value > cut.value
        score = score + passed.cast("int")
    return (F.lit(6) - score if reverse else score).cast("int")


def segment_rule(r: Column, f: Column, m: Column, tenure: Column) -> Column:
    """The named segment for three scores and the tenure in days."""
    active, engaged, valuable = r >= 4, f >= 4, m >= 4
    quiet = r <= 2
    return (F.when(active & engaged & valuable, "Champions")
             .when((r >= 3) & (engaged | valuable), "Loyal")
             .when(active & (f <= 2) & (tenure <= 60), "New")
             .when(quiet & ((f >= 3) | (m >= 3)), "At-risk")
             .when(quiet, "Dormant")
             .when((f <= 2) & (tenure <= 90), "New")
             .otherwise("Loyal"))


def score_customers(features: DataFrame) -> DataFrame:
    """Adds R, F, M, segment and rfm_cell.

    ``features`` is read three times (two small aggregations for the cuts, then the
    result): pass a staged table.
    """
    cuts = quintile_cuts(features, ["recency", "frequency", "monetary"])
    scored = features.select(
        "*",
        quintile(F.col("recency"), cuts["recency"], reverse=True).alias("R"),
        quintile(F.col("frequency"), cuts["frequency"]).alias("F"),
        quintile(F.col("monetary"), cuts["monetary"]).alias("M"),
    )
    return scored.select(
        "*",
        segment_rule(F.col("R"), F.col("F"), F.col("M"), F.col("tenure_days"))
         .alias("segment"),
        F.concat(F.col("R").cast("string"), F.col("F").cast("string"),
                 F.col("M").cast("string")).alias("rfm_cell"),
    )


def segment_order(segment: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), segment).cast("int")


def segment_profile(scored: DataFrame) -> DataFrame:
    """One row per segment present: size, revenue, shares and mean behaviour, with one
    decimal. ``position`` is the display order. The window runs over at most five rows."""
    per_segment = scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        grand_total(units(F.col("monetary"))).alias("revenue"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("avg_order_value").alias("avg_order_value"),
    )
    everyone = Window.partitionBy()
    customer_share = F.col("customers") / F.sum("customers").over(everyone) * 100
    revenue_share = F.try_divide(F.col("revenue"), F.sum("revenue").over(everyone)) * 100
    return per_segment.select(
        "segment",
        segment_order(F.col("segment")).alias("position"),
        "customers",
        half_even(F.col("revenue"), 1).alias("revenue"),
        half_even(F.col("avg_recency"), 1).alias("avg_recency"),
        half_even(F.col("avg_frequency"), 1).alias("avg_frequency"),
        half_even(F.col("revenue") / F.col("customers"), 1).alias("avg_monetary"),
        half_even(F.col("avg_order_value"), 1).alias("avg_order_value"),
        half_even(customer_share, 1).alias("share_pct"),
        half_even(revenue_share, 1).alias("rev_share_pct"),
    )
