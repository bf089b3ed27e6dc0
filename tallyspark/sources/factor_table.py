"""Daily factor files: a date column and any other columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_text_date
from ..functions.numbers import plain_number
from ..operators.factors import RESERVED

# Parts of a header that mark the date column.
DATE_HINTS = ("date", "datum", "day", "den")


def date_column(columns: list[str]) -> str:
    """The first column whose name holds a hint, else the first column."""
    return next((c for c in columns if any(h in c.lower() for h in DATE_HINTS)), columns[0])


def shape_factors(raw: DataFrame, date_col: str | None = None,
                  row_key: str | None = None) -> DataFrame:
    """Text table -> one row per day. A column is numeric when half its cells are; the
    first non-empty cell of the day in reading order wins. Columns named like the sales
    series get the prefix ``factor_``."""
    columns = [c for c in raw.columns if c != row_key]
    date_col = date_col or date_column(columns)
    others = [c for c in columns if c != date_col]
    q = {c: F.col(f"`{c}`") for c in columns}
    shares = raw.agg(*[(F.count_if(plain_number(q[c]).isNotNull())
                        / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(f"s{i}")
                       for i, c in enumerate(others)]).first() if others else ()
    order = F.col(row_key) if row_key else F.monotonically_increasing_id()
    day = F.to_date(parse_text_date(F.regexp_replace(q[date_col], r"\.0$", ""), False,
                                    ("iso", "short", "other"), False))
    names = {c: f"factor_{c}" if c.lower() in RESERVED else c for c in others}
    cells = raw.select(
        day.alias("date"), order.alias("row_order"),
        *[(plain_number(q[c]) if shares[i] >= 0.5 else q[c]).alias(names[c])
          for i, c in enumerate(others)]).where(F.col("date").isNotNull())

    def first(name):
        cell = F.col(f"`{name}`")
        return F.min_by(cell, F.when(cell.isNotNull(), F.col("row_order"))).alias(name)

    grouped = cells.groupBy("date")
    if not others:
        return grouped.agg(F.count(F.lit(1)).alias("n")).select("date")
    return grouped.agg(*[first(names[c]) for c in others])


def read_factors(spark: SparkSession, path: str, date_col: str | None = None) -> DataFrame:
    """Comma-separated factor file(s) with a header."""
    raw = spark.read.csv(path, header=True, escape='"', inferSchema=False)
    # Reading order: file by file, block by block, line by line; the id alone follows the
    # scheduler's packing of blocks.
    order = F.struct("_metadata.file_path", "_metadata.file_block_start",
                     F.monotonically_increasing_id())
    return shape_factors(raw.withColumn("_reading_order", order), date_col, "_reading_order")
