"""Order lines from a relational database through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import UnusableInput


def jdbc_options(url: str, query: str, partition_column: str | None = None,
                 bounds: tuple | None = None, partitions: int = 32,
                 fetch_size: int = 10_000, **extra: str) -> dict[str, str]:
    """Reader options. With a partition column and its bounds the query is read in
    parallel ranges; without them one task reads everything, so large tables need both."""
    options = {"url": url, "fetchsize": str(fetch_size), **extra}
    if partition_column is None:
        return {**options, "query": query}
    if bounds is None:
        raise UnusableInput("a partition column needs its lower and upper bound")
    return {**options, "dbtable": f"({query}) order_lines",
            "partitionColumn": partition_column, "numPartitions": str(partitions),
            "lowerBound": str(bounds[0]), "upperBound": str(bounds[1])}


def read_relational(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """The rows of a SELECT, as the database types them; map them with ``canonicalize``."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()
