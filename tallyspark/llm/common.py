"""Small helpers shared by the operators: tables, plain columns, words and hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Golden-ratio and finaliser multipliers of the usual 64-bit mixer.
GOLDEN, MIX1, MIX2 = (np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The named column as ``kind``; nulls of that kind where the table lacks it."""
    return df[name].cast(kind) if name in df.columns else F.lit(None).cast(kind)


#: What Python workers remember from task to task, by module, and how to forget it.
_FORGET: dict[str, Callable[[], None]] = {}
_AT_WORK: list[str] = [""]


def remembered(module: str, forget: Callable[[], None]) -> None:
    _FORGET[module] = forget


def at_work(module: str) -> None:
    """A worker remembers for one operator only: what others have left is forgotten."""
    if _AT_WORK[0] != module:
        _AT_WORK[0] = module
        for other, forget in _FORGET.items():
            if other != module:
                forget()


def map_batches(df: DataFrame, work: Callable, schema: str, megabytes: int = 8) -> DataFrame:
    """``work`` turns column lists into column lists, for about ``megabytes`` of rows at a time.

    A generator may give several results for one; an empty table gives an empty table.
    """
    from pyspark.sql.types import StructType

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work(work.__module__)
        for batch in batches:
            step = max(1, int(batch.num_rows * megabytes * 1e6 / max(1, batch.nbytes)))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                for out in work(*(c.to_pylist() for c in part.columns)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, x.type) for v, x in zip(out, kinds, strict=True)],
                        schema=kinds)

    return df.mapInArrow(run, schema)


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value, one to one."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for the words met so far."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_BYTES[_BLANK] = 0


def hash_words(texts: list[bytes | None], block: int = 1 << 19) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, A-Z in lower case.

    All words of a block of texts are hashed together, byte by byte, without a Python object
    for any of them: the sum of a random number per byte times a power of its place.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size < block):
            some.append(texts[at] or b"")
            size += len(some[-1]) + 1
            at += 1
        raw = _LOWER[np.frombuffer(b" ".join([*some, b""]), np.uint8)]
        blank = _BLANK[raw]
        first = ~blank
        first[1:] &= blank[:-1]
        starts = np.flatnonzero(first)
        offsets = np.cumsum([0, *[len(t) + 1 for t in some]])
        if not len(starts):
            out += [np.empty(0, np.uint64)] * len(some)
            continue
        place = np.arange(len(raw)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
        place[blank] = 0
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(place.max()) + 1, GOLDEN, np.uint64))
            hashes = mix(np.add.reduceat(_BYTES[raw] * powers[place], starts))
        ends = np.searchsorted(starts, offsets)
        out += [hashes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])]


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than the six ASCII blanks."""
    return text.split() if text else []


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words in order; of all words where there are fewer."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        total = np.full(n, size, np.uint64)
        for k in range(size):
            total = mix(total * GOLDEN + words[k:k + n])
    return total
