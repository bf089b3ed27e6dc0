"""Removal of repeated passages: every byte under a string of ``length`` bytes that also starts in
a document with a smaller id.

Splitting the work. The strings of ``length`` bytes (windows) are dealt out by their minimizer,
the least hash of the 20-byte grams inside: equal windows have equal minimizers, and a run
of neighbouring windows has one in common, so a run travels as one short segment. First the
minimizers alone are exchanged, and only segments whose minimizer occurs in two documents
travel after that. Documents stand in chunks of a fixed size; a chunk sends a segment only
once, for its smallest document, since its copies there are known to be repeats. So a passage
in a third of all documents is one short row per chunk, not one per document.

In a bucket: breadth-first interval expansion on a Burrows-Wheeler transform. The rows are the
window ends in sorted order; the column beside each holds the symbol (eight bytes) before it.
Extending backwards by one symbol is a stable sort of that column, which for all intervals at
once gives the intervals of the strings that are one symbol longer: common prefixes of 8, 16,
24 ... bytes in increasing order. An interval with rows of one document only is given up at
once. The expansion stops at ``length``; in each interval left, the windows whose document is
not the smallest are repeats.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; a null id is
compared with nothing and kept whole; rows with one id are not smaller than one another; the
judged strings are those of the input, so overlaps count. Very long texts are compared whole;
an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage

from .common import GOLDEN, MIX1, MIX2, column, map_batches, mix, squeeze, unsqueeze

#: Bytes of a window, of a symbol, of the grams whose least hash is the minimizer, and of a
#: minimizer when it is exchanged (two that agree in these bytes only send a segment more).
LENGTH, GRAM, ANCHOR, KEY = 50, 8, 20, 6
#: Bytes of a chunk, and of input for each bucket of minimizers and of segments.
CHUNK, PER_MINIMIZER_BUCKET, PER_SEGMENT_BUCKET = 2_000_000, 1 << 25, 1 << 22
#: Compression of what is written and exchanged: disk counts for more here than time.
LEVEL = 6


def _to_chunks(ids: list, texts: list):
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    out: tuple[list, ...] = ([], [], [], [])
    at = 0
    while at < len(order):
        some, size = [], 0
        while at < len(order) and (not some or size + len(texts[order[at]] or b"") <= CHUNK):
            some.append(order[at])
            size += len(texts[order[at]] or b"")
            at += 1
        for values, x in zip(out, ([ids[k] for k in some], [len(texts[k] or b"") for k in some],
                                   size, squeeze(b"".join(texts[k] or b"" for k in some), LEVEL)),
                             strict=True):
            values.append(x)
    yield out


def chunks_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    """A written table of chunks: number, ids in order, sizes and the bytes of their texts."""
    base = docs.select(column(docs, id, "long").alias("doc_id"),
                       column(docs, text, "binary").alias("body"))
    made = map_batches(base, _to_chunks, "ids array<long>, sizes array<long>, "
                       "total long, data binary", megabytes=32)
    return stage(made.select(F.monotonically_increasing_id().alias("chunk"), "ids", "sizes",
                             "total", "data"), "chunks")


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    n = len(data) - GRAM + 1
    return np.ndarray((n,), "<u8", data, strides=(1,)).copy()


class Runs:
    """Runs of windows with one minimizer, over all documents of a chunk."""

    def __init__(self, ids: list, sizes: list, data: bytes, length: int) -> None:
        self.data = data
        ends = np.cumsum(sizes, dtype=np.int64)
        starts = ends - np.array(sizes, np.int64)
        usable = np.array([i is not None for i in ids], bool) & (ends - starts >= length)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        raw = np.frombuffer(data, np.uint8)
        if not usable.any():
            self.start = self.end = self.doc = np.empty(0, np.int64)
            self.key = np.empty(0, np.uint64)
            return
        symbols, n = grams(raw), len(raw) - ANCHOR + 1
        with np.errstate(over="ignore"):
            hashes = symbols[:n] * GOLDEN
            for offset, factor in ((GRAM, MIX1), (ANCHOR - GRAM, MIX2)):
                hashes ^= hashes >> np.uint64(32)
                hashes += symbols[offset:offset + n]
                hashes *= factor
            hashes ^= hashes >> np.uint64(32)
            hashes *= GOLDEN
        least, width, wanted = hashes, 1, length - ANCHOR + 1
        while width < wanted:
            step = min(width, wanted - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        # A run begins where the minimizer changes and where a document begins.
        change = np.empty(len(least), bool)
        change[0] = True
        np.not_equal(least[1:], least[:-1], out=change[1:])
        change[starts[usable]] = True
        last = ends[usable] - length  # the last window of a document
        after = last + 1
        change[after[after < len(change)]] = True
        begin = np.flatnonzero(change)
        stop = np.append(begin[1:], len(least))
        doc = np.searchsorted(ends, begin, "right")
        inside = usable[np.minimum(doc, len(usable) - 1)] & (begin <= ends[np.minimum(
            doc, len(ends) - 1)] - length)
        self.start, self.doc = begin[inside], doc[inside]
        self.end = stop[inside] - 1 + length
        self.key = least[self.start]


def packed(keys: np.ndarray) -> bytes:
    """The low bytes of the minimizers."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // KEY, 8), np.uint8)
    wide[:, :KEY] = np.frombuffer(data, np.uint8).reshape(-1, KEY)
    return wide.view("<u8").ravel()


def pack_meta(*columns: list[int]) -> bytes:
    """Columns of whole numbers, as differences, compressed."""
    return squeeze(np.diff(np.array(columns, np.int64), axis=1, prepend=0).tobytes())


def unpack_meta(data: bytes, columns: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(unsqueeze(data), np.int64).reshape(columns, -1), axis=1)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys) % np.uint64(buckets)).astype(np.int64)


def _minimizers(buckets: int, length: int):
    def work(numbers, ids, sizes, data):
        for number, i, s, d in zip(numbers, ids, sizes, data, strict=True):
            runs = Runs(i, s, unsqueeze(d), length)
            order = np.argsort(runs.key, kind="stable")
            keys, docs = runs.key[order], runs.ids[runs.doc[order]]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
            if not len(keys):
                continue
            many = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
            keys = keys[first]
            where = bucket_of(keys, buckets)
            order = np.argsort(where, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(where[order]) != 0))
            out: tuple[list, ...] = ([], [], [], [])
            for a, b in pairwise([*cut.tolist(), len(order)]):
                part = order[a:b]
                for values, x in zip(out, (int(where[part[0]]), number, packed(keys[part]),
                                           np.packbits(many[part]).tobytes()), strict=True):
                    values.append(x)
            yield out
    return work


def _shared(table):
    """Of a bucket: for each chunk its minimizers that occur in two documents."""
    import pyarrow as pa

    numbers = table["chunk"].to_pylist()
    keys = [unpacked(x) for x in table["keys"].to_pylist()]
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool)
             for x, k in zip(table["many"].to_pylist(), keys, strict=True)]
    found, back, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    # Chunks may hold rows of one id, so two chunks are taken for two documents here.
    good = n > 1
    good[back[np.concatenate(flags)]] = True
    hit, at, rows = good[back], 0, ([], [])
    for number, k in zip(numbers, keys, strict=True):
        mine = k[hit[at:at + len(k)]]
        at += len(k)
        if len(mine):
            rows[0].append(number)
            rows[1].append(packed(mine))
    return pa.table({"chunk": pa.array(rows[0], pa.int64()), "shared": pa.array(rows[1], pa.binary())})


def _segments(buckets: int, length: int):
    def work(numbers, ids, sizes, data, shared):
        for number, i, s, d, parts in zip(numbers, ids, sizes, data, shared, strict=True):
            runs = Runs(i, s, unsqueeze(d), length)
            good = np.isin(runs.key & np.uint64((1 << 8 * KEY) - 1), unpacked(b"".join(parts)))
            where = bucket_of(runs.key[good], buckets).tolist()
            sent: dict[int, tuple[list, list, list]] = {}
            seen: dict[bytes, int] = {}
            spans: list[int] = []
            for start, end, doc, bucket in zip(
                    runs.start[good].tolist(), runs.end[good].tolist(),
                    runs.ids[runs.doc[good]].tolist(), where, strict=True):
                segment = runs.data[start:end]
                # Documents stand in the order of their ids.
                if seen.setdefault(segment, doc) < doc:
                    spans += (start, end)
                else:
                    texts, docs, places = sent.setdefault(bucket, ([], [], []))
                    texts.append(segment)
                    docs.append(doc)
                    places.append(start)
            out: tuple[list, ...] = ([], [], [], [], [])
            for bucket, (texts, docs, places) in sent.items():
                for values, x in zip(out, (bucket, number, squeeze(b"".join(texts), LEVEL), pack_meta(
                        list(map(len, texts)), docs, places), None), strict=True):
                    values.append(x)
            if spans:
                # What is known here already only passes through some bucket.
                for values, x in zip(out, (number % buckets, number, None, None,
                                           pack_meta(spans)), strict=True):
                    values.append(x)
            yield out
    return work


def expand(text: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Which windows (by their starts in ``text``) equal one of a smaller document.

    ``rows`` is the order of the transform, ``interval`` numbers the intervals of the strings
    expanded so far. Offsets give the places of the symbols, from the end of a window back to
    its start; the last symbol overlaps the one before it.
    """
    repeat = np.zeros(len(starts), bool)
    symbols = grams(text)
    rows = np.arange(len(starts))
    interval = np.zeros(len(starts), np.int64)
    for offset in [*range(length - GRAM, 0, -GRAM), 0]:
        symbol = symbols[starts[rows] + offset]
        order = np.argsort(symbol, kind="stable")
        rows, interval, symbol = rows[order], interval[order], symbol[order]
        new = np.append(True, (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1]))
        first = np.flatnonzero(new)
        here = docs[rows]
        least = np.minimum.reduceat(here, first)
        alive = least != np.maximum.reduceat(here, first)
        interval = np.cumsum(new) - 1
        stay = alive[interval]
        if offset == 0:
            repeat[rows[here > least[interval]]] = True
        rows, interval = rows[stay], interval[stay]
        if not len(rows):
            break
    return repeat


def _repeats(length: int):
    def work(table):
        import pyarrow as pa
        import pyarrow.compute

        known = table.filter(pa.compute.is_valid(table["spans"]))
        table = table.filter(pa.compute.is_null(table["spans"]))
        through = (known["chunk"].to_pylist(), known["spans"].to_pylist())
        if not table.num_rows:
            return pa.table({"chunk": pa.array(through[0], pa.int64()),
                             "spans": pa.array(through[1], pa.binary())})
        where: dict[bytes, int] = {}
        distinct: list[bytes] = []
        kind, docs, places, chunks = [], [], [], []
        for number, segments, meta in zip(table["chunk"].to_pylist(), table["segments"].to_pylist(),
                                          table["meta"].to_pylist(), strict=True):
            sizes, ids, starts = unpack_meta(meta, 3)
            text, at = unsqueeze(segments), 0
            for n in sizes.tolist():
                segment = text[at:at + n]
                at += n
                k = where.setdefault(segment, len(distinct))
                if k == len(distinct):
                    distinct.append(segment)
                kind.append(k)
            docs.append(ids)
            places.append(starts)
            chunks += [number] * len(ids)
        kinds, doc, place = np.array(kind), np.concatenate(docs), np.concatenate(places)
        # Equal segments stand once, for their smallest document.
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, kinds, doc)
        sizes = np.array(list(map(len, distinct)))
        windows = sizes - length + 1
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(distinct)), windows)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = expand(np.frombuffer(b"".join(distinct), np.uint8), begin[owner] + inner,
                     least[owner], length)
        # Runs of repeats inside a segment: (segment, first window, last window).
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        broken: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while a < b:
                k = int(owner[a])
                stop = min(b, a + int(windows[k] - inner[a]))
                broken.setdefault(k, []).append((int(inner[a]), int(inner[a]) + stop - a))
                a = stop
        spans: dict[int, list[int]] = {}
        for k, d, p, number in zip(kind, doc.tolist(), place.tolist(), chunks, strict=True):
            if d > least[k]:
                spans.setdefault(number, []).extend((p, p + int(sizes[k])))
            else:
                for a, b in broken.get(k, ()):
                    spans.setdefault(number, []).extend((p + a, p + b - 1 + length))
        return pa.table({
            "chunk": pa.array([*spans, *through[0]], pa.int64()),
            "spans": pa.array([*map(pack_meta, spans.values()), *through[1]], pa.binary())})
    return work


def _cut(ids, sizes, data, spans):
    for i, s, d, parts in zip(ids, sizes, data, spans, strict=True):
        text = unsqueeze(d)
        edge = np.zeros(len(text) + 1, np.int32)
        for part in parts or []:
            both = unpack_meta(part, 1).reshape(-1, 2)
            np.add.at(edge, both[:, 0], 1)
            np.add.at(edge, both[:, 1], -1)
        gone = np.cumsum(edge)[:-1] > 0
        raw, at, out = np.frombuffer(text, np.uint8), 0, ([], [], [], [], [])
        for doc, n in zip(i, s, strict=True):
            mine = gone[at:at + n]
            rest = raw[at:at + n][~mine].tobytes() if mine.any() else text[at:at + n]
            runs = int(np.count_nonzero(mine[1:] & ~mine[:-1])) + int(n > 0 and mine[0])
            for values, x in zip(out, (doc, n, n - len(rest), runs, rest), strict=True):
                values.append(x)
            at += n
        yield out


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text",
                   length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the bytes that are left (``kept``)."""
    if length < ANCHOR:
        raise ValueError(f"length must be at least {ANCHOR}")
    chunks = chunks_of(docs, id, text)
    total = chunks.agg(F.sum("total")).first()[0] or 0
    keys = map_batches(chunks.select("chunk", "ids", "sizes", "data"),
                       _minimizers(max(12, total // PER_MINIMIZER_BUCKET), length),
                       "bucket long, chunk long, keys binary, many binary")
    shared = keys.groupBy("bucket").applyInArrow(_shared, "chunk long, shared binary")
    # A chunk's lists are bounded by its size.
    shared = shared.groupBy("chunk").agg(F.collect_list("shared").alias("shared"))
    sent = map_batches(chunks.join(shared, "chunk").select("chunk", "ids", "sizes", "data", "shared"),
                       _segments(max(12, total // PER_SEGMENT_BUCKET), length),
                       "bucket long, chunk long, segments binary, meta binary, spans binary")
    spans = (sent.groupBy("bucket").applyInArrow(_repeats(length), "chunk long, spans binary")
             .groupBy("chunk").agg(F.collect_list("spans").alias("spans")))
    return map_batches(
        chunks.join(spans, "chunk", "left").select("ids", "sizes", "data", "spans"), _cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    """The result with a digest in place of the bytes."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))
