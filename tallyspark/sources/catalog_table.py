"""The product catalog file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATALOG_COLUMNS


def read_catalog(spark: SparkSession, path: str) -> DataFrame | None:
    """Catalog with text columns, missing cells empty; None when the file is absent or has
    no product id."""
    try:
        raw = spark.read.csv(path, header=True, escape='"', inferSchema=False)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if "product_id" not in raw.columns:
        return None
    have = ["product_id"] + [c for c in CATALOG_COLUMNS if c in raw.columns]
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in have])


def append_catalog(rows: DataFrame, path: str) -> None:
    """Add rows to a catalog folder."""
    rows.write.mode("append").csv(path, header=True, escape='"')
