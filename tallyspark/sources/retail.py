"""Parquet order lines in the public online-retail layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.canonical import canonicalize

# Source columns of the public data set.
RETAIL_MAPPING = {
    "customer_id": "CustomerID", "order_id": "InvoiceNo", "order_date": "InvoiceDate",
    "quantity": "Quantity", "unit_price": "UnitPrice", "product": "Description",
    "country": "Country",
}


def read_retail(spark: SparkSession, path: str) -> DataFrame:
    """Canonical frame with ``drop_reason``; only the seven columns are read."""
    return canonicalize(spark.read.parquet(path), RETAIL_MAPPING)
