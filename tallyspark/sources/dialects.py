"""How the text exports of a folder are written: one row per file.

All of this reads whole files as splittable lines. Encoding and quoting are decided by one
aggregation over every line; delimiter and header come from each file's first lines.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

# Delimiters an export may use.
DELIMITERS = ",|;\t"
# Lines that tell the delimiter, and lines among which a header is looked for.
SNIFF_LINES = 20
HEADER_WITHIN = 30

# Bytes above 127 as single-byte text, and what windows-1250 makes of them.
_HIGH = bytes(range(0x80, 0x100))
_UNDEFINED = [chr(b) for b in _HIGH if not bytes([b]).decode("cp1250", "ignore")]
_DEFINED = "".join(chr(b) for b in _HIGH if chr(b) not in _UNDEFINED)
_CP1250 = "".join(bytes([ord(c)]).decode("cp1250") for c in _DEFINED)
_FILLED = re.compile(r'[^\s,;|"]')
_HEADS = pa.schema([("file", pa.string()), ("rank", pa.int32()), ("raw", pa.string()),
                    ("empty", pa.int32())])


def cp1250_from_latin1(text: Column) -> Column:
    """Text read as ISO-8859-1 -> the text its bytes mean in windows-1250."""
    return F.translate(text, _DEFINED, _CP1250)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", "true").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block_start")))


def _latin1(line: Column) -> Column:
    return F.decode(line.cast("binary"), "ISO-8859-1")


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, multiline) from every line of every file.

    UTF-8 when all lines are valid UTF-8, else windows-1250 unless a byte it lacks occurs,
    else ISO-8859-1. ``multiline`` is set when some line leaves a quote open.
    """
    line = F.col("value")
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    return (_lines(spark, path).groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(line)).alias("utf8"),
        F.bool_or(~F.is_valid_utf8(line)
                  & _latin1(line).rlike("[" + "".join(_UNDEFINED) + "]")).alias("undefined"),
        F.bool_or(quotes % 2 == 1).alias("multiline"))
        .select("file",
                F.when(F.col("utf8"), "utf-8").when(F.col("undefined"), "latin-1")
                 .otherwise("cp1250").alias("encoding"), "multiline"))


def head_lines(spark: SparkSession, path: str, most: int = HEADER_WITHIN + 1) -> DataFrame:
    """(file, rank, raw, empty): the first ``most`` non-blank lines of each file, as single-byte
    text, and how many lines of separators alone stand above.

    Lines of a file's first block come in file order, so each task passes on no more than the
    first of them, without sorting the block.
    """
    first = _lines(spark, path).where(F.col("block_start") == 0).select(
        "file", F.col("value").cast("binary").alias("raw"))

    def run(batches):
        file, rank, empty = None, 0, 0
        for batch in batches:
            out, at = [], 0
            names, raws = batch.columns
            # Most lines are below the first of a long file, and are passed over at once.
            ends = pc.fill_null(pc.not_equal(names[1:], names[:-1]), True).to_numpy(
                zero_copy_only=False) if len(names) > 1 else np.zeros(0, bool)
            for end in [*(np.flatnonzero(ends) + 1).tolist(), len(names)]:
                if end > at and names[at].as_py() != file:
                    file, rank, empty = names[at].as_py(), 0, 0
                while rank < most and at < end:
                    raw = raws[at].as_py().decode("latin-1")
                    at += 1
                    if _FILLED.search(raw):
                        rank += 1
                        out.append({"file": file, "rank": rank, "raw": raw, "empty": empty})
                    elif raw.strip():
                        empty += 1
                at = end
            yield pa.RecordBatch.from_pylist(out, schema=_HEADS)

    return first.mapInArrow(run, "file string, rank int, raw string, empty int")


def decoded(raw: Column, encoding: Column) -> Column:
    """Single-byte text of a line -> what its bytes mean in the file's encoding."""
    utf8 = F.decode(F.encode(raw, "ISO-8859-1"), "UTF-8")
    return (F.when(encoding == "utf-8", F.regexp_replace(utf8, "^\ufeff", ""))
             .when(encoding == "cp1250", cp1250_from_latin1(raw)).otherwise(raw))


def _outside_quotes(delimiter: str) -> str:
    """Pattern of a delimiter with an even number of quotes behind it."""
    return rf'\Q{delimiter}\E(?=(?:[^"]*"[^"]*")*[^"]*$)'


def delimiters(heads: DataFrame, sniff_lines: int = SNIFF_LINES) -> DataFrame:
    """(file, delimiter): the candidate that occurs equally often in most of the first lines.

    Counts are taken outside quotes. Of equally even candidates the one that occurs more often
    in a line wins, then the one that is rarer inside numbers and prose.
    """
    bare = F.regexp_replace("line", r'"[^"]*"', "")
    counts = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.lit(k).alias("preference"),
                                (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))))
                                .alias("times"))
                       for k, d in enumerate(DELIMITERS)])
    seen = (heads.where(F.col("rank") <= sniff_lines).select("file", F.explode(counts).alias("c"))
            .where("c.times > 0").groupBy("file", "c.delimiter", "c.preference", "c.times")
            .agg(F.count(F.lit(1)).alias("lines")))
    return seen.groupBy("file").agg(
        F.max_by("delimiter", F.struct("lines", "times", "preference")).alias("delimiter"))


def header_rows(heads: DataFrame, within: int = HEADER_WITHIN) -> DataFrame:
    """(file, at): the first line with two filled cells that the next line has as many cells as.

    Without such a line the first one serves.
    """
    by_line = Window.partitionBy("file").orderBy("rank")
    filled = F.size(F.filter("cells", lambda c: c.rlike(r"(?U)\S")))
    sized = heads.select("file", "rank", filled.alias("filled"), F.size("cells").alias("n"),
                         F.lead(F.size("cells")).over(by_line).alias("below"))
    fits = (F.col("filled") >= 2) & (F.col("n") == F.col("below")) & (F.col("rank") <= within)
    return sized.groupBy("file").agg(F.coalesce(F.min(F.when(fits, F.col("rank"))),
                                                F.lit(1)).alias("at"))


def repaired_names(headers: DataFrame) -> DataFrame:
    """(file, columns) from (file, cells): blank names become ``col<i>``, repeated ones get
    ``_2``, ``_3`` and so on in their order."""
    named = headers.select("file", F.posexplode("cells").alias("at", "cell")).select(
        "file", "at", F.regexp_replace("cell", r"(?U)^[\s\ufeff]+|\s+$", "").alias("bare"))
    named = named.withColumn("name", F.when(F.col("bare") == "", F.concat(
        F.lit("col"), F.col("at") + 1)).otherwise(F.col("bare")))
    turn = F.row_number().over(Window.partitionBy("file", "name").orderBy("at"))
    named = named.withColumn("turn", turn)
    name = F.when(F.col("turn") == 1, F.col("name")).otherwise(
        F.concat("name", F.lit("_"), F.col("turn")))
    listed = F.array_sort(F.collect_list(F.struct("at", name.alias("name"))))
    return named.groupBy("file").agg(listed["name"].alias("columns"))


def dialect_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file below ``path``: encoding, quoting, delimiter, header row and
    column names; ``plain`` where the header is the first line that is not empty."""
    # A row per file and a few lines of each, read several times below: written once.
    facts = stage(file_facts(spark, path), "facts")
    heads = stage(head_lines(spark, path).join(facts.select("file", "encoding"), "file").select(
        "file", "rank", "empty", decoded(F.col("raw"), F.col("encoding")).alias("line")), "heads")
    heads = heads.join(delimiters(heads), "file", "left").withColumn(
        "delimiter", F.coalesce("delimiter", F.lit(",")))
    split = F.when(F.lit(False), F.array(F.col("line")))
    for d in DELIMITERS:
        split = split.when(F.col("delimiter") == d, F.split("line", _outside_quotes(d)))
    cells = F.transform(split, lambda c: F.when(
        c.rlike(r'^\s*".*"\s*$'),
        F.replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    heads = heads.withColumn("cells", cells)
    marked = heads.join(header_rows(heads), "file")
    names = repaired_names(marked.where("rank = at").select("file", "cells"))
    rows = marked.groupBy("file").agg(
        F.first("delimiter").alias("delimiter"), (F.first("at") - 1).cast("int").alias("skipped_rows"),
        (F.max(F.when(F.col("rank") == F.col("at"), F.col("empty") + F.col("at"))) == 1).alias("plain"),
        (F.count(F.lit(1)) > 1).alias("has_data"))
    return facts.join(rows, "file").join(names, "file").select(
        "file", "encoding", "multiline", "delimiter", "skipped_rows", "columns", "plain",
        "has_data")
