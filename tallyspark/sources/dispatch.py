"""One entry point for all kinds of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnusableInput
from ..operators.canonical import REASON, canonicalize, require_columns
from ..operators.header_mapping import (
    column_evidence, map_headers, missing_required, table_cells)
from ..schema import REASON_QUOTE
from .delimited import read_tables
from .order_json import ORDER_MAPPING, read_order_pages
from .partner_shop import read_partner_shop
from .relational import read_relational
from .retail import read_retail

KINDS = ("file", "sql", "json", "sample", "partner")


def _mapped(spark: SparkSession, tables: list) -> DataFrame:
    """(table, canonical, header) of the headers of all dialects."""
    return map_headers(spark.createDataFrame(
        [(str(i), at, name) for i, (dialect, _, _) in enumerate(tables)
         for at, name in enumerate(dialect.columns)],
        "table string, position int, header string"))


def _number_cells(table: DataFrame, name: str, chosen: dict[str, str]) -> DataFrame:
    """The cells of the columns for quantity and money; dates and texts tell no number format."""
    columns = [f"`{chosen[c]}`" for c in ("quantity", "unit_price", "line_value")
               if chosen.get(c) in table.columns]
    return table_cells(table.select(*columns), name)


def _chosen(mapped: DataFrame) -> dict[str, dict[str, str]]:
    found: dict[str, dict[str, str]] = {}
    for row in mapped.collect():                          # one row per mapped header
        found.setdefault(row.table, {})[row.canonical] = row.header
    return found


def describe_exports(spark: SparkSession, path: str) -> DataFrame:
    """What would be read: per dialect its delimiter, encoding, mapping, decimal mark, currency,
    language and the required columns that no header stands for."""
    tables = read_tables(spark, path)
    mapped = _mapped(spark, tables)
    chosen = _chosen(mapped)
    known = [(str(i), d.delimiter, d.encoding, chosen.get(str(i), {}))
             for i, (d, _, _) in enumerate(tables)]
    facts = spark.createDataFrame(
        known, "table string, delimiter string, encoding string, mapping map<string,string>")
    numbers, texts = [], []
    for i, (dialect, table, _) in enumerate(tables):
        mark = F.lit(dialect.delimiter)
        numbers.append(column_evidence(
            _number_cells(table, str(i), chosen.get(str(i), {})), delimiter=mark))
        texts.append(column_evidence(table_cells(table, str(i)), delimiter=mark))
    numbers, texts = (reduce(DataFrame.unionByName, x) for x in (numbers, texts))
    return (facts.join(numbers.select("table", "decimal"), "table", "left")
            .join(texts.select("table", "currency", "language"), "table", "left")
            .join(missing_required(mapped), "table", "left"))


def load_exports(spark: SparkSession, path: str, mapping: dict[str, str] | None = None,
                 decimal: str | None = None) -> DataFrame:
    """A folder of text exports of any dialect -> one canonical frame.

    What the caller leaves open is inferred per dialect: columns from the header names, the
    number format from the cells of the columns for quantity and money. Files are grouped by
    dialect, so there are as many parts as dialects. Lines behind a quote that nothing closes
    are rows without values, with their own reason.
    """
    tables = read_tables(spark, path)
    inferred = _chosen(_mapped(spark, tables))
    parts = []
    for i, (dialect, table, lost) in enumerate(tables):
        chosen = {**inferred.get(str(i), {}), **(mapping or {})}
        require_columns([c for c, h in chosen.items() if h in dialect.columns])
        mark = decimal or (column_evidence(_number_cells(table, "t", chosen),
                                           delimiter=F.lit(dialect.delimiter))
                           .first().decimal)
        parts.append(canonicalize(table, chosen, mark))
        if lost is not None:
            parts.append(lost.select(F.explode(F.sequence(F.lit(1), F.col("lines").cast("int"))))
                         .select(F.lit(REASON_QUOTE).alias(REASON)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load(spark: SparkSession, kind: str, mapping: dict[str, str] | None = None,
         decimal: str | None = None, **options) -> DataFrame:
    """Canonical frame with ``drop_reason`` from any source.

    kind: file (path), sql (url, query, ...), json (path), sample (path), partner (path).
    Without ``decimal`` files are examined for theirs and other sources use a point.
    """
    if kind == "file":
        return load_exports(spark, options["path"], mapping, decimal)
    decimal = decimal or "."
    if kind == "sql":
        return canonicalize(read_relational(spark, **options), mapping, decimal)
    if kind == "json":
        return canonicalize(read_order_pages(spark, **options),
                            {**ORDER_MAPPING, **(mapping or {})}, decimal)
    if kind == "sample":
        return read_retail(spark, options["path"])
    if kind == "partner":
        return read_partner_shop(spark, options["path"])
    raise UnusableInput(f"unknown source kind {kind!r}; expected one of {KINDS}")
