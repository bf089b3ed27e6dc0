"""Records of text files whose cells hold line breaks, read in splits like any other text.

Where a line starts, a reader is outside all cells or inside a quoted one. A block of a file is
therefore a function of two states: each block is gone through once for both starts, a window
over the blocks of a file (one row per block) chains the functions, and then every block is
parsed by itself from the state it really starts in, thousands of records at a time. Only the ends of records that cross a block
are put together afterwards. Quotes have their usual meaning: they open a cell only at its start,
and a doubled quote inside stands for one.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

#: Python's names of the encodings of exports.
CODECS = {"utf-8": "utf-8", "cp1250": "cp1250", "latin-1": "latin-1"}
_FILLED = re.compile(rb'[^\s,;|"]')
_BARE = re.compile(rb"\r(?!\n)")


def line_blocks(spark: SparkSession, files: list[str]) -> DataFrame:
    """(line, file, block): lines in the order of the file within each block."""
    return (spark.read.option("lineSep", "\n").text(files)
            .select(F.col("value").cast("binary").alias("line"),
                    F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block")))


def inside_after(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether a quoted cell is open at the end of a line."""
    if b'"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == b'"':
                at += 2
                continue
            inside, at = False, at + 1
        elif line[at:at + 1] == b'"':
            inside, at = True, at + 1
            continue
        # The rest of the cell is plain, whatever quotes it holds.
        at = line.find(delimiter, at) + 1
        if not at:
            return False


class _Patterns:
    """Text of whole lines, gone through many records at a time. A cell that starts with a quote
    ends at the next single one and what is plain behind it; other cells end at a separator."""

    def __init__(self, delimiter: str):
        d = re.escape(delimiter).encode()
        rest = rb'(?:[^"]++|"")*+"[^%s\n]*+' % d
        cell = rb'(?:"%s|[^"%s\n][^%s\n]*+)?+' % (rest, d, d)
        record = rb'%s(?:%s%s)*+\n' % (cell, d, cell)
        #: A record; as many as there are; the end of one whose quoted cell is open.
        self.record = re.compile(record)
        self.records = re.compile(rb'(?:%s)*+' % record)
        self.rest = re.compile(rb'%s(?:%s%s)*+\n' % (rest, d, cell))

    def split(self, text: bytes, inside: bool) -> tuple[int, int]:
        """Where the record that is open at the start ends, and the last whole record does; -1 and
        0 where the quoted cell stays open."""
        if not inside:
            return 0, self.records.match(text).end()
        first = self.rest.match(text)
        return (first.end(), self.records.match(text, first.end()).end()) if first else (-1, 0)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array]]:
    """Runs of rows of one block: (file, block) and its lines so far, in order."""
    for batch in batches:
        lines, files, blocks = batch.columns
        n = len(lines)
        other = (pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
                 | (np.diff(blocks.to_numpy()) != 0)) if n > 1 else np.zeros(0, bool)
        starts = [0, *(np.flatnonzero(other) + 1).tolist()] if n else []
        for begin, end in zip(starts, [*starts[1:], n]):
            yield (files[begin].as_py(), blocks[begin].as_py()), lines[begin:end]


def _text(lines: pa.Array) -> bytes:
    return b"\n".join(lines.to_pylist()) + b"\n"


def block_ends(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file, block, from_out, from_in): the state at a block's end for both starts."""
    mark, patterns = delimiter.encode(), _Patterns(delimiter)

    def run(batches):
        known, state = None, [False, True]

        def told():
            return pa.RecordBatch.from_pylist([{
                "file": known[0], "block": known[1], "from_out": state[0], "from_in": state[1]}])

        for key, some in _runs(batches):
            if key != known:
                if known:
                    yield told()
                known, state = key, [False, True]
            text, at = _text(some), 0
            # From quote to quote, a line at a time, until both starts have come to the same state.
            while state[0] != state[1] and (quote := text.find(b'"', at)) >= 0:
                begin, at = text.rfind(b"\n", at, quote) + 1 or at, text.index(b"\n", quote) + 1
                state = [inside_after(text[begin:at - 1], s, mark) for s in state]
            if state[0] == state[1] and at < len(text):
                rest = text[at:]
                state = [patterns.split(rest, state[0])[1] < len(rest)] * 2
        if known:
            yield told()

    return lines.mapInArrow(run, "file string, block long, from_out boolean, from_in boolean")


def block_starts(ends: DataFrame) -> DataFrame:
    """(file, block, inside, open): the state a block starts and ends in.

    A block keeps, turns or sets the state. What the last setting block before left, turned as
    often as blocks turn it since, is the start.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    turns = (F.col("from_out") & ~F.col("from_in")).cast("int")
    counted = ends.withColumn("turns", turns).withColumn(
        "so_far", F.coalesce(F.sum("turns").over(before), F.lit(0)))
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct(
        F.col("from_out").cast("int").alias("left"), F.col("so_far").alias("turned")))
    last = F.last(fixed, ignorenulls=True).over(before)
    inside = F.pmod(F.coalesce(last["left"], F.lit(0)) + F.col("so_far")
                    - F.coalesce(last["turned"], F.lit(0)), F.lit(2)) == 1
    return counted.select("file", "block", inside.alias("inside"), F.when(
        inside, F.col("from_in")).otherwise(F.col("from_out")).alias("open"))


def _cells(text: bytes, codec: str, delimiter: str, width: int) -> list[list[str]]:
    """A record's cells, cut or padded to ``width``; none where all are blank."""
    csv.field_size_limit(sys.maxsize)
    whole = text.decode(codec, "replace")
    try:
        rows = list(csv.reader(io.StringIO(whole, newline=""), delimiter=delimiter))
    except csv.Error:  # a bare carriage return, which ends a line too
        rows = list(csv.reader(io.StringIO(whole.replace("\r", "\n"), newline=""),
                               delimiter=delimiter))
    return [(r + [""] * width)[:width] for r in rows if any(c.strip() for c in r)]


def _table(rows: list[list[str]], width: int) -> list[pa.Array]:
    """Columns of cells from rows of the same width."""
    return [pa.array([r[i] for r in rows], pa.string()) for i in range(width)]


def _many(text: bytes, codec: str, delimiter: str, width: int,
          patterns: _Patterns) -> list[list[str]]:
    """The cells of a run of whole records."""
    if not _BARE.search(text):
        csv.field_size_limit(sys.maxsize)
        whole = io.StringIO(text.decode(codec, "replace"), newline="")
        try:
            return [r if len(r) == width else (r + [""] * width)[:width]
                    for r in csv.reader(whole, delimiter=delimiter) if "".join(r).strip()]
        except csv.Error:
            pass
    # A bare carriage return ends a line within its own record alone.
    return [r for m in patterns.record.finditer(text) if m.group()
            for r in _cells(m.group()[:-1], codec, delimiter, width)]


def _pieces(delimiter: str, codec: str, width: int, known: dict[str, dict[int, tuple]]):
    """Whole records as cells, without the titles and the header of a file's first block, and
    the raw ends of records that cross a block. ``known`` tells by file and block whether it
    starts inside a quoted cell, and how many lines are left out."""
    patterns = _Patterns(delimiter)
    ends = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.string()),
                      ("text", pa.binary()), ("lines", pa.int64())])
    names = [*ends.names, *(f"c{i}" for i in range(width))]

    def end(key, kind, text):
        return pa.RecordBatch.from_arrays(
            [*pa.RecordBatch.from_pylist([{
                "file": key[0], "block": key[1], "kind": kind, "text": text[:-1],
                "lines": text.count(b"\n")}], schema=ends).columns,
             *(pa.nulls(1, pa.string()) for _ in range(width))], names=names)

    def whole(rows):
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.repeat(pa.scalar("whole"), n),
             pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), *_table(rows, width)], names=names)

    def run(batches):
        # Lines that no record of the block so far ends with, and whether they began in it.
        at, open_, inside, through, skip = None, [], False, False, 0

        def left():
            return [end(at, "through" if through else "tail", b"".join(open_))] if open_ else []

        for key, some in _runs(batches):
            if key != at:
                yield from left()
                at, open_ = key, []
                inside, skip = known[key[0]][key[1]]
                through, skip = inside, skip if key[1] == 0 else 0
            text = _text(some)
            first, last = patterns.split(text, inside)
            if first < 0:
                open_.append(text)
                continue
            rows = []
            if inside:
                record = b"".join([*open_, text[:first]])
                if through:
                    yield end(at, "head", record)
                elif skip:
                    skip -= bool(_FILLED.search(record))
                else:
                    rows = _cells(record[:-1], codec, delimiter, width)
            while skip and first < last:
                record = patterns.record.match(text, first)
                skip -= bool(_FILLED.search(record.group()))
                first = record.end()
            rows += _many(text[first:last], codec, delimiter, width, patterns)
            if rows:
                yield whole(rows)
            inside, through = last < len(text), False
            open_ = [text[last:]] if inside else []
        yield from left()

    return run


def read_records(spark: SparkSession, files: DataFrame, paths: list[str], delimiter: str,
                 encoding: str, width: int) -> tuple[DataFrame, DataFrame | None]:
    """(cells) of every record below the headers, and (file, lines) lost to open quotes.

    ``files(file, skipped_rows)`` tells the title lines above each header. What is sent to the
    tasks has one entry per block. The second result is None where every quote is
    closed within its block; lines behind a quote that no line closes are counted there, and
    the record keeps what stands in the line that opens it.
    """
    lines = line_blocks(spark, paths)
    codec = CODECS[encoding]
    starts = stage(block_starts(block_ends(lines, delimiter)), "blocks")
    known: dict[str, dict[int, tuple]] = {}
    for r in starts.join(files, "file", "left").select(
            "file", "block", "inside", (F.coalesce("skipped_rows", F.lit(-1)) + 1)
            .alias("skip")).collect():
        known.setdefault(r.file, {})[r.block] = (r.inside, r.skip)
    names = [f"c{i}" for i in range(width)]
    texts = ", ".join(f"{n} string" for n in names)
    # Written once, in columns: what follows reads some of them several times.
    pieces = stage(lines.mapInArrow(
        _pieces(delimiter, codec, width, known),
        f"file string, block long, kind string, text binary, lines long, {texts}"), "pieces")
    cells = F.array(*names).alias("cells")
    found = pieces.where("kind = 'whole'").select(*names)
    if starts.where("inside or open").isEmpty():
        return found.select(cells), None
    # A record begins in the last block before that has a tail; at most two ends per block.
    origin = F.last(F.when(F.col("kind") == "tail", F.col("block")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("block", F.col("kind") == "tail"))
    ends = pieces.where("kind <> 'whole'").select(
        "file", "block", "kind", "lines", F.decode("text", "ISO-8859-1").alias("text"),
        origin.alias("origin"))
    crossing = stage(ends.groupBy("file", "origin").agg(
        F.bool_or(F.col("kind") == "head").alias("closed"), F.sum("lines").alias("lines"),
        F.max(F.when(F.col("kind") == "tail", F.split_part("text", F.lit("\n"), F.lit(1))))
        .alias("text")), "crossing")
    closed = (ends.join(F.broadcast(crossing.where("closed").select("file", "origin")),
                        ["file", "origin"])
              .groupBy("file", "origin")
              .agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"))
              .select(F.array_join("parts.text", "\n").alias("text")))

    def parse(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_table(
                [r for t in batch.column(0).to_pylist()
                 for r in _cells(t.encode("latin-1"), codec, delimiter, width)], width), names=names)

    parsed = closed.unionByName(crossing.where("not closed").select("text")).mapInArrow(
        parse, texts)
    return (found.unionByName(parsed).select(cells),
            crossing.where("not closed and lines > 1").select(
                "file", (F.col("lines") - 1).alias("lines")))
