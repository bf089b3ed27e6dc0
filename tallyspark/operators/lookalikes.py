"""Customers most like one customer, or like a whole segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnusableInput
from ..functions.money import grand_total, half_even, units
from .clusters import SCALED

SHOWN = ["customer_id", "recency", "frequency", "monetary", "avg_order_value", "segment"]


def unit_columns() -> list[Column]:
    """The scaled features divided by their length (plus 1e-9)."""
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in SCALED[1:]),
                        F.col(SCALED[0]) * F.col(SCALED[0]))) + F.lit(1e-9)
    return [F.col(c) / length for c in SCALED]


def _dot(weights: list[float]) -> Column:
    parts = [u * F.lit(float(w)) for u, w in zip(unit_columns(), weights)]
    return sum(parts[1:], parts[0])


def _nearest(candidates: DataFrame, weights: list[float], k: int) -> DataFrame:
    """Top-k by similarity, then id; every task keeps k rows, nothing is sorted whole."""
    shown = [c for c in SHOWN if c in candidates.columns]
    return (candidates.select(*shown, _dot(weights).alias("exact"))
            .orderBy(F.desc("exact"), "customer_id").limit(max(0, k))
            .select("customer_id", half_even(F.col("exact"), 3).alias("similarity"),
                    *shown[1:]))


def lookalikes(scaled: DataFrame, customer_id: str, k: int = 8) -> DataFrame:
    """The k customers closest to one customer by cosine, itself excluded."""
    anchor = (scaled.where(F.col("customer_id") == customer_id)
              .select(*[u.alias(c) for c, u in zip(SCALED, unit_columns())]).first())
    if anchor is None:
        raise UnusableInput(f"unknown customer_id {customer_id!r}")
    return _nearest(scaled.where(F.col("customer_id") != customer_id), list(anchor), k)


def expand_segment(scaled: DataFrame, segment: str, k: int = 15) -> DataFrame:
    """The k non-members closest to the mean member of ``segment``; empty without members.

    The centre is one aggregation to six numbers; ranking is a top-k over the rest.
    """
    members = scaled.where(F.col("segment") == segment)
    centre = members.agg(*[F.avg(u).alias(c) for c, u in zip(SCALED, unit_columns())]).first()
    if centre[0] is None:
        return _nearest(scaled.where(F.lit(False)), [0.0] * len(SCALED), 0)
    return _nearest(scaled.where(F.col("segment") != segment), list(centre), k)


def seed_segment(profile: DataFrame) -> DataFrame:
    """One row (seed): Champions when there are any, else the segment with the largest
    revenue share, the first in display order on ties."""
    return profile.agg(
        F.coalesce(F.max(F.when(F.col("segment") == "Champions", F.col("segment"))),
                   F.max_by("segment", F.struct(F.col("rev_share_pct"),
                                                (-F.col("position")).alias("p"))))
        .alias("seed"))


def prospect_statistics(prospects: DataFrame, seed: str, customers: int,
                        revenue: float) -> DataFrame:
    """Size, shares and mean behaviour of a prospect list."""
    return prospects.agg(
        F.lit(seed).alias("for_segment"),
        F.count(F.lit(1)).alias("customers"),
        half_even(F.count(F.lit(1)) / max(customers, 1) * 100, 1).alias("share_pct"),
        half_even(grand_total(units(F.col("monetary"))) / (revenue or 1.0) * 100, 1)
        .alias("rev_share_pct"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        (grand_total(units(F.col("monetary"))) / F.count(F.lit(1))).alias("avg_monetary"),
        F.avg("avg_order_value").alias("avg_order_value"))
