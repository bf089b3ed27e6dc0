"""Text exports of any dialect -> text tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnusableInput
from ..session import stage
from .dialects import cp1250_from_latin1, dialect_profile
from .records import read_records


@dataclass(frozen=True)
class Dialect:
    """How some files are written; ``by_records`` where the header is not a file's first line or
    a cell holds a line break."""

    encoding: str
    delimiter: str
    by_records: bool
    columns: tuple[str, ...]


def _read_lines(spark: SparkSession, files: list[str], dialect: Dialect) -> DataFrame:
    """Files whose first line is the header and whose lines are records: Spark's own reader,
    which leaves out exactly that line of each file."""
    names = list(dialect.columns)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = (spark.read.schema(schema)
           .option("sep", dialect.delimiter).option("header", True)
           .option("enforceSchema", True).option("mode", "PERMISSIVE").option("escape", '"')
           .option("encoding", "UTF-8" if dialect.encoding == "utf-8" else "ISO-8859-1")
           .csv(files))
    cells = [F.col(f"c{i}") for i in range(len(names))]
    if dialect.encoding == "cp1250":
        cells = [cp1250_from_latin1(c) for c in cells]
    cells = [F.coalesce(c, F.lit("")) for c in cells]
    return (raw.where(F.concat(*cells).rlike(r"(?U)\S"))
            .select(*[c.alias(n) for c, n in zip(cells, names)]))


def read_dialect(spark: SparkSession, files: list[str], dialect: Dialect,
                 headers: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Files of one dialect as one frame of text columns, and (file, lines) lost to open quotes.

    Short rows are padded, long ones cut, blank ones dropped, empty cells are ''. Title lines
    and the header are left out by their number: ``headers`` has (file, skipped_rows). A later
    line that equals one of them is a row like others.
    """
    if not dialect.by_records:
        return _read_lines(spark, files, dialect), None
    names = dialect.columns
    rows, lost = read_records(spark, headers, files, dialect.delimiter, dialect.encoding,
                              len(names))
    return rows.select(*[F.col("cells")[i].alias(n) for i, n in enumerate(names)]), lost


def read_tables(spark: SparkSession,
                path: str) -> list[tuple[Dialect, DataFrame, DataFrame | None]]:
    """Per dialect found below ``path`` its text table and the lines lost to open quotes.

    The driver gets one row per dialect, with the paths of its files.
    """
    profile = stage(dialect_profile(spark, path), "dialects").where("has_data")
    groups = profile.groupBy("encoding", "delimiter", (
        F.col("multiline") | ~F.col("plain")).alias("by_records"), "columns").agg(
        F.sort_array(F.collect_list("file")).alias("files"))
    rows = sorted(groups.collect(), key=lambda r: r.files[0])
    if not rows:
        raise UnusableInput(f"no data rows below {path}")
    headers = profile.select("file", "skipped_rows")
    out = []
    for r in rows:
        dialect = Dialect(r.encoding, r.delimiter, r.by_records, tuple(r.columns))
        out.append((dialect, *read_dialect(spark, list(r.files), dialect, headers)))
    return out
