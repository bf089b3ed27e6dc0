"""Nested order documents, as landed pages of a shop's order interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the part of the page that is used.
PAGE_SCHEMA = """
data struct<orders: array<struct<
  email: string, code: string, creationTime: string,
  billingAddress: struct<country: string>,
  items: array<struct<amount: string, name: string, itemPrice: struct<withVat: string>>>>>>
"""
# Canonical name -> flattened column.
ORDER_MAPPING = {
    "customer_id": "customer_email", "order_id": "order_code", "order_date": "creation_time",
    "quantity": "amount", "unit_price": "price", "product": "name", "country": "country",
}


def flatten_orders(pages: DataFrame) -> DataFrame:
    """One row per order item; orders without items give none."""
    orders = pages.select(F.explode("data.orders").alias("o"))
    return (orders.select(
        F.col("o.email").alias("customer_email"), F.col("o.code").alias("order_code"),
        F.col("o.creationTime").alias("creation_time"),
        F.col("o.billingAddress.country").alias("country"), F.explode("o.items").alias("i"))
        .select("customer_email", "order_code", "creation_time",
                F.col("i.amount").alias("amount"),
                F.col("i.itemPrice.withVat").alias("price"),
                F.col("i.name").alias("name"), "country"))


def read_order_pages(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Flattened items of all pages below ``path``: one JSON document per line, or per file
    with ``multiline``."""
    pages = spark.read.schema(PAGE_SCHEMA).option("multiLine", multiline).json(path)
    return flatten_orders(pages)
