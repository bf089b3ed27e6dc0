"""Best-two-fit packing of token sequences into bins of a fixed size.

A bin is filled greedily with the longest unpacked piece that fits. Before it is closed, its
smallest piece is exchanged for two unpacked pieces if together they fill the widened gap
more tightly.

Only lengths decide, and there are at most ``size`` of them, so the plan is made on a table
of counts per length: each step fills as many equal bins as the counts allow and gives one
row (a pattern and how often it is used). Bins, places and documents are matched by rank:
the r-th piece of a length takes the r-th place of that length. The ranks come from counts
per (length, slice) and row numbers inside a slice, so no task sees all pieces of a length,
and the driver holds two tables whose size depends on the bin and not on the input.

Defined results: a null text is empty and has only the closing id; null ids and repeated
rows are packed like others; very long texts are cut into pieces, the last of which may be
short; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.session import stage

from .common import column, map_batches, remembered

SIZE, CLOSING = 2048, 0
#: Marks that may close a word of letters.
MARKS = ".,;:!?*$%&#"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the other bytes for 256, 257 and so on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Ids (little-endian 32-bit) of a word between blanks, by a tokenizer without context
    across blanks. Words of Latin letters with closing marks are looked up by part."""

    #: Words, and as many parts, that are remembered: some 250 MB of a worker at most.
    LIMIT = 1_000_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.parts: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        """``part``: lower-case Latin letters, or closing marks."""
        if len(self.parts) >= self.LIMIT:
            self.parts.clear()
        # ASCII letters and marks stand for their own bytes.
        spelled = part if part.isascii() else (
            part.encode().decode("latin-1").translate(self.letters))
        self.parts[part] = ids = _packed([token.id for token in self.tokenize(spelled)])
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        text = word.decode(errors="replace")
        bare = text.rstrip(MARKS)
        # Letters below U+0100 have one lower case and are their own normal form.
        if bare.isalpha() and (bare.isascii() or max(bare) < "Ā"):
            low, known = bare.lower(), self.parts.get
            value = known(low) or self._part(low)
            if len(bare) < len(text):
                marks = text[len(bare):]
                value += known(marks) or self._part(marks)
        else:
            value = self._whole(unicodedata.normalize("NFC", text))
        self[word] = value
        return value

    def of(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if text else b""


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The words met so far; a Python worker keeps them from task to task."""
    return WordIds(path)


remembered(__name__, word_ids.cache_clear)


def _pieces(path: str, size: int, with_ids: bool):
    def work(ids: list, texts: list):
        known, rows = word_ids(path), []
        for doc, text in zip(ids, texts, strict=True):
            packed = known.of(text) + np.array([CLOSING], "<u4").tobytes()
            for piece, start in enumerate(range(0, len(packed), 4 * size)):
                part = packed[start:start + 4 * size]
                rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part),
                             np.frombuffer(part, "<u4").tolist() if with_ids else None))
        yield [list(x) for x in zip(*rows, strict=True)]

    return work


def pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text",
           size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``size`` ids, of every document; only longer ones are cut."""
    base = docs.select(column(docs, id, "long").alias("doc_id"),
                       column(docs, text, "binary").alias("body"))
    return map_batches(base, _pieces(path, size, with_ids),
                       "doc_id long, piece int, start long, length long, ids_crc32 long, "
                       "ids array<int>")


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin's pieces, in order) and how many bins use each."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    while left.any():
        here = np.flatnonzero(left)
        taken = [int(here[-1])]
        free = left.copy()
        free[taken[0]] -= 1
        gap = size - taken[0]
        while gap and (fit := np.flatnonzero(free[:gap + 1])).size:
            best = int(fit[-1])
            taken.append(best)
            free[best] -= 1
            gap -= best
        if gap and len(taken) > 1:
            pair = _best_two(free, gap + taken[-1])
            if pair and sum(pair) > taken[-1]:
                taken[-1:] = pair
        used = np.bincount(taken, minlength=size + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        patterns.append((taken, times))
    return patterns


def _best_two(free: np.ndarray, room: int) -> list[int] | None:
    """The two unpacked lengths with the largest sum up to ``room``."""
    here = np.flatnonzero(free[:room + 1])
    if not len(here):
        return None
    at = np.searchsorted(here, room - here, "right") - 1
    second = np.where(at >= 0, here[at], 0)
    # A length that is left once cannot be taken twice: the next shorter one then.
    same = (second == here) & (free[here] < 2)
    second = np.where(same, np.where(at > 0, here[np.maximum(at - 1, 0)], 0), second)
    total = np.where(second > 0, here + second, 0)
    k = int(np.argmax(total))
    return [int(here[k]), int(second[k])] if total[k] else None


def places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each pattern and length: first rank, places, first bin, places a bin, first offset.

    Equal lengths of a pattern lie side by side, so an offset follows from the rank.
    """
    rows, given, first = [], {}, 0
    for taken, times in patterns:
        offset = 0
        for length in dict.fromkeys(taken):
            each = taken.count(length)
            start = given.get(length, 0)
            rows.append((length, start, start + each * times, first, each, offset))
            given[length] = start + each * times
            offset += each * length
        first += times
    return rows


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with their sequence and offset. ``parts`` must be a table that reads the same
    twice (a written one): it needs the columns doc_id, piece and length."""
    spark = parts.sparkSession
    counts = parts.groupBy("length").agg(F.count("*").alias("n"))
    # At most ``size`` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in counts.collect()}
    slots = places(plan_bins(histogram, size))
    # A slice holds about this many rows, so rows of a slice and slices of a length both grow
    # with the square root of the input.
    step = max(256, math.isqrt(sum(histogram.values())))
    sliced = parts.join(F.broadcast(spark.createDataFrame(
        [(k, -(-n // step)) for k, n in histogram.items()], "length long, slices long")), "length")
    sliced = sliced.select(*parts.columns, F.pmod(
        F.xxhash64("doc_id", "piece"), F.col("slices")).cast("int").alias("slice"))
    number = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece"))
    sizes = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")
    first = sizes.select("length", "slice", before.alias("first"))
    ranked = (sliced.withColumn("number", number).join(first, ["length", "slice"])
              .withColumn("rank", F.col("first") + F.col("number") - 1))
    slot = spark.createDataFrame(
        slots, "length long, low long, high long, bin long, each long, base long")
    per_length = slot.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("low", "high", "bin", "each", "base"))).alias("slots"))
    # A binary search would be possible; a length has few patterns.
    hit = F.filter("slots", lambda s: (F.col("rank") >= s["low"]) & (F.col("rank") < s["high"]))
    placed = ranked.join(per_length, "length").withColumn("at", hit[0])
    inside = F.col("rank") - F.col("at.low")
    return placed.select(
        *parts.columns,
        (F.col("at.bin") + F.floor(inside / F.col("at.each"))).alias("sequence_id"),
        (F.col("at.base") + F.pmod(inside, F.col("at.each")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text",
                   size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """Every document cut into pieces and packed: doc_id, piece, start, length, ids_crc32, ids,
    sequence_id, offset. Without ``with_ids`` the column ids is null."""
    return pack(stage(pieces(docs, path, id, text, size, with_ids), "pieces"), size)
