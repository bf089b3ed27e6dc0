"""Partner-shop export: one row per order line, Czech money, naive timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_text_date
from ..functions.numbers import czech_money, plain_number
from ..operators.canonical import canonicalize_shop, compute_once

# Columns of the export that are used.
COLUMNS = ["customer_key", "order_id", "order_datetime", "product_quantity", "unit_price",
           "revenue_per_line", "cost_per_line", "product_id", "country", "order_status",
           "zip_prefix"]


def typed_shop_lines(raw: DataFrame) -> DataFrame:
    """Text export -> typed frame; money keeps its sign, the total comes from
    ``revenue_per_line``. Columns the export lacks are null or empty."""
    def text(name):
        return (F.coalesce(F.col(name).cast("string"), F.lit("")) if name in raw.columns
                else F.lit(""))

    costly = [parse_text_date(text("order_datetime"), False, ("iso", "short", "other"), False).alias("order_date"),
              czech_money(text("revenue_per_line")).alias("line_value")]
    carried = [
        text("customer_key").alias("customer_id"), text("order_id").alias("order_id"),
        plain_number(text("product_quantity")).alias("quantity"),
        czech_money(text("unit_price")).alias("unit_price"),
        czech_money(text("cost_per_line")).alias("line_cost"),
        text("product_id").alias("product"), text("country").alias("country"),
        text("order_status").alias("status"), text("zip_prefix").alias("zip_prefix")]
    return compute_once(raw, costly, carried)


def read_partner_shop(spark: SparkSession, path: str) -> DataFrame:
    """Canonical frame with ``drop_reason`` and ``is_product``."""
    raw = spark.read.csv(path, header=True, escape='"', inferSchema=False)
    return canonicalize_shop(typed_shop_lines(raw))
