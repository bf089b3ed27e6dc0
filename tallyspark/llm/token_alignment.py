"""Alignment of two tokenizers: byte ranges of their tokens, groups, links and link counts.

*Interval coalescing.* Tokens of both sides are byte ranges. All of them are sorted together by
their starts; the running maximum of the ends says how far the tokens so far reach, and a group
breaks where a start reaches it. Within a group every A token is linked with every B token whose
range overlaps it; as either side tiles the text, these are runs of neighbours, written out by
repetition, so the links are as many as they are and no pair is tried in vain.

*Words once.* Neither tokenizer has a token across the start of a white space run that begins
with a blank or line end (``separable`` proves it from the vocabulary files), so both cut there
and the text between two such places, a stretch, is aligned by itself. A worker aligns the
stretches it has not met lately in one go, and a document is the sequence of its stretches.
A vocabulary without that property is aligned text by text.

*Counts over the corpus.* A document's distinct id pairs are kept as one packed column. Pair
counts are summed in workers before they are shuffled. A table of the most frequent pairs, at
most ``COMMON`` by a histogram of the counts, goes to every worker; the other pairs meet their
counts in a join, where no key can be hot, since each of them is rare. Highest counts by B id are
as many as the vocabulary has ids.

Defined results: null and empty texts, and texts that the joined token bytes of either side do
not give back, have no tokens: zeros, and '' for the digest. White space alone is a text like
others. Very long texts are cut into stretches like others; a text without white space is one
stretch of any length. Repeated rows, and rows without id, each count and come back. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage

from .common import at_work, column, map_batches, remembered, squeeze, unsqueeze

#: Most pairs sent to every worker, at 16 bytes each.
COMMON = 500_000
#: Stretches that a worker remembers (in each of two generations), and the longest of them.
REMEMBER, LONGEST = 150_000, 60
#: Stretches tokenized as one text, and what stands in front of them.
TOGETHER, LEAD = 200, " x"
#: Links gathered in a worker before their counts are added up.
GATHER = 4_000_000

#: From white space or the start to the next white space that begins with a blank or line end
#: and is not the end of the text. The letter apart is white space to some tables only.
_STRETCH = re.compile(r"[\s᠎]*[^\s᠎]+(?:(?![ \n])[\s᠎]+[^\s᠎]+)*"
                      r"(?:[\s᠎]+\Z)?|[\s᠎]+\Z")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones stand
    for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and what this worker remembers."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(letters.get(x, 63) for x in self.a.id_to_token(k))
                        for k in range(size)]
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        self.decimal = [str(k) for k in range(max(size, len(self.bytes_b)))]
        with open(path_a, encoding="utf-8") as file:
            told = json.load(file)
        self.separable = told.get("normalizer") is None and (
            told["pre_tokenizer"]["type"], told["pre_tokenizer"].get("add_prefix_space"),
            told["pre_tokenizer"].get("use_regex", True)) == ("ByteLevel", False, True) and not any(
            b" " in x.lstrip(b" ") or (b"\n" in x and x != b"\n")
            for x in self.bytes_b)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return (bytes([int(piece[3:5], 16)]) if self.b.is_byte(k)
                else piece.replace("▁", " ").encode())

    def aligned(self, some: list[str]) -> list[tuple | None]:
        """(number of A ids, groups as text, links) of each stretch; None where bytes differ."""
        out: list[tuple | None] = [None] * len(some)
        last = [k for k, x in enumerate(some) if x[-1].isspace() or not self.separable]
        rest = sorted(set(range(len(some))) - set(last))
        todo = [[k] for k in last] + [rest[k:k + TOGETHER] for k in range(0, len(rest), TOGETHER)]
        all_a, all_b, sizes, whose = [], [], [], []
        while todo:
            these = todo.pop()
            # Stretches one behind the other are a text of which each is a stretch; the one in
            # front stands for the start of a text.
            parts = [LEAD, *map(some.__getitem__, these)] if self.separable else [some[these[0]]]
            text = "".join(parts)
            a = self.a.encode(text, add_special_tokens=False).ids
            b = self.b.encode(text[1:])
            raw = text.encode()
            if raw == b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(
                    map(self.bytes_b.__getitem__, b)):
                all_a += a
                all_b += b
                sizes += [len(x.encode()) for x in parts]
                whose += [-1] * (len(parts) - len(these)) + these
            elif len(these) > 1:
                half = len(these) // 2
                todo += [these[:half], these[half:]]
        if not whose:
            return out
        a, b = np.array(all_a), np.array(all_b)
        text, counts, links, many = align(a, self.len_a[a], b, self.len_b[b], np.cumsum(sizes),
                                          self)
        raw, at = links.tobytes(), 0
        for k, n, words, size in zip(whose, counts.tolist(), text,
                                     (many * links.itemsize).tolist(), strict=True):
            if k >= 0:
                out[k] = n, words, raw[at:at + size]
            at += size
        return out

    def of(self, some: set[str]) -> dict[str, tuple | None]:
        """Alignments of stretches, from memory where they were met lately."""
        got, new = {}, []
        for x in some:
            hit = self.young.get(x, 0)
            if hit == 0 and (hit := self.old.get(x, 0)) != 0:
                self.young[x] = hit
            if hit == 0:
                new.append(x)
            else:
                got[x] = hit
        for x, found in zip(new, self.aligned(new) if new else (), strict=True):
            got[x] = found
            if len(x) <= LONGEST:
                self.young[x] = found
        if len(self.young) > REMEMBER:
            self.old, self.young = self.young, {}
        return got


def link_kind(size_a: int, size_b: int) -> type:
    return np.uint32 if size_a * size_b < 2**32 else np.uint64


def align(a: np.ndarray, len_a: np.ndarray, b: np.ndarray, len_b: np.ndarray,
          bounds: np.ndarray, vocab: Tokenizers):
    """Groups and links of two tilings of the same bytes, by stretches that end at ``bounds``.

    Gives the groups of each stretch as text, its number of A tokens, all links as pairs (A id
    times the number of B ids, plus B id) in the order of A, and each stretch's number of links.
    """
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    start_a, start_b = end_a - len_a, end_b - len_b
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.cumsum(np.append(False, start[order][1:] >= reach[:-1]))
    # Within a group its A tokens come first, then its B tokens, both by start.
    laid = order[np.lexsort((side[order], group))]
    ids, kind = np.concatenate([a, b])[laid], side[laid]
    stop = np.where(np.append(group[1:] != group[:-1], True), 2,
                    np.append(kind[1:] != kind[:-1], False))
    tokens = np.searchsorted(end_a, bounds, "right")
    stop[tokens + np.searchsorted(end_b, bounds, "right") - 1] = 3
    words = [""] * (2 * len(ids))
    words[::2] = map(vocab.decimal.__getitem__, ids.tolist())
    words[1::2] = map((",", "|", ";", "\n").__getitem__, stop.tolist())
    text = "".join(words).split("\n")[:-1]
    # Overlaps: from the first B token that ends behind the start of A, as long as they begin
    # before its end; they never leave the group, at whose bounds both sides have ends.
    low = np.searchsorted(end_b, start_a, "right")
    many = np.searchsorted(start_b, end_a, "left") - low
    place = np.repeat(np.arange(len(a)), many)
    other = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + low[place]
    links = (a[place] * len(vocab.bytes_b) + b[other]).astype(
        link_kind(len(vocab.bytes_a), len(vocab.bytes_b)))
    by_stretch = np.diff(np.append(0, np.cumsum(many))[tokens], prepend=0)
    return text, np.diff(tokens, prepend=0), links, by_stretch


_HERE: dict[tuple[str, str], Tokenizers] = {}
remembered(__name__, _HERE.clear)


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    at_work(__name__)
    if (path_a, path_b) not in _HERE:
        _HERE[path_a, path_b] = Tokenizers(path_a, path_b)
    return _HERE[path_a, path_b]


def stretches(text: str, vocab: Tokenizers) -> list[str]:
    """The text with a blank in front, cut where both tokenizers cut."""
    return _STRETCH.findall(" " + text) if vocab.separable else [" " + text]


def _measure(path_a: str, path_b: str):
    def work(doc_id, text):
        vocab = tokenizers(path_a, path_b)
        kind = link_kind(len(vocab.bytes_a), len(vocab.bytes_b))
        cut = [stretches(x, vocab) if x else [] for x in text]
        gc.disable()  # what is remembered holds no cycles; else it is walked again and again
        known = vocab.of(set(chain.from_iterable(cut)))
        out: list[list] = [[], [], [], [], [], [], []]
        for parts in cut:
            found = list(map(known.__getitem__, parts))
            row = (0, 0, 0, 0, "", b"", b"")
            if found and None not in found:
                n, texts, raw = zip(*found, strict=True)
                groups = ";".join(texts)
                n_a, n_groups = sum(n), groups.count(";") + 1
                links = np.frombuffer(b"".join(raw), kind)
                pairs, times = np.unique(links, return_counts=True)
                row = (n_a, groups.count(",") + groups.count("|") + n_groups - n_a, n_groups,
                       len(links), hashlib.sha256(groups.encode()).hexdigest(),
                       squeeze(pairs.tobytes()), squeeze(times.astype(np.uint32).tobytes()))
            for column_, value in zip(out, row, strict=True):
                column_.append(value)
        del known, cut
        gc.enable()
        yield doc_id, *out

    return work


MEASURED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, "
            "groups_sha256 string, pairs binary, times binary")


def measured(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Counts, digest and packed distinct id pairs of every document, with a row number."""
    rows = map_batches(docs.select(column(docs, "doc_id", "long").alias("doc_id"),
                                   column(docs, "text", "string").alias("text")),
                       _measure(path_a, path_b), MEASURED, megabytes=2)
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")


def _unpacked(pairs: bytes, times: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(unsqueeze(pairs), kind),
            np.frombuffer(unsqueeze(times), np.uint32).astype(np.int64))


def _added(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their times."""
    if not pairs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    every = np.concatenate(pairs)
    order = np.argsort(every, kind="stable")
    every, many = every[order], np.concatenate(times)[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[first], np.add.reduceat(many, first)


def pair_counts(rows: DataFrame, kind: type) -> DataFrame:
    """(pair, n): how many links of all ``rows(pairs, times)`` hold each pair."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work(__name__)
        pairs: list[np.ndarray] = []
        times: list[np.ndarray] = []
        size = 0

        def told(pairs, times):
            return pa.RecordBatch.from_pydict({"pair": pa.array(pairs.astype(np.int64)),
                                               "n": pa.array(times)})

        for batch in batches:
            for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p:
                    more = _unpacked(p, t, kind)
                    pairs.append(more[0])
                    times.append(more[1])
                    size += len(more[0])
                if size >= GATHER:
                    one = _added(pairs, times)
                    if len(one[0]) > GATHER // 2:
                        yield told(*one)
                        one = _added([], [])
                    pairs, times, size = [one[0].astype(kind)], [one[1]], len(one[0])
        yield told(*_added(pairs, times))

    partial = rows.select("pairs", "times").mapInArrow(add, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


def frequent_bound(counts: DataFrame, most: int = COMMON) -> int:
    """The least power of two such that at most ``most`` pairs are counted so often or more."""
    power = F.length(F.bin("n")).alias("power")
    bound, taken = 0, 0
    for row in sorted(counts.groupBy(power).count().collect(), key=lambda r: -r["power"]):
        taken += row["count"]
        if taken > most:
            return 2 ** row["power"]
        bound = 2 ** (row["power"] - 1)
    return bound


def _judge(common, best, kind: type, size_b: int):
    """A document's links that have known counts; a row more for each pair that has none."""

    def work(row, pairs, times):
        known, count = common.value
        highest = best.value
        out: list[list] = [[], [], [], [], []]
        for at, p, t in zip(row, pairs, times, strict=True):
            if not p:
                continue
            pair, many = _unpacked(p, t, kind)
            spot = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            hit = known[spot] == pair if len(known) else np.zeros(len(pair), bool)
            n = count[spot[hit]] if len(known) else np.empty(0, np.int64)
            top = highest[(pair[hit] % kind(size_b)).astype(np.int64)] == n
            rest = ~hit
            others = int(rest.sum())
            for values, more in zip(out, (
                    [at] * (others + 1), [None, *pair[rest].tolist()], [0, *many[rest].tolist()],
                    [int(many[hit][top].sum())] + [0] * others,
                    [int((many[hit] * n).sum())] + [0] * others), strict=True):
                values.extend(more)
        yield tuple(out)

    return work


def align_documents(docs: DataFrame, path_a: str, path_b: str,
                    common_pairs: int = COMMON) -> DataFrame:
    """``measured`` with ``n_best`` and ``count_sum`` of every document."""
    spark = docs.sparkSession
    rows = measured(docs, path_a, path_b)
    vocab = Tokenizers(path_a, path_b)
    size_b = len(vocab.bytes_b)
    kind = link_kind(len(vocab.bytes_a), size_b)
    counts = stage(pair_counts(rows, kind), "pairs")
    bound = frequent_bound(counts, common_pairs)
    many = F.col("n") >= bound
    told = counts.where(many).toArrow().to_pydict()
    order = np.argsort(np.array(told["pair"], np.int64))
    common = spark.sparkContext.broadcast((np.array(told["pair"], np.int64)[order].astype(kind),
                                           np.array(told["n"], np.int64)[order]))
    # One row for each id of the second vocabulary.
    highest = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("highest"))
    top = np.zeros(size_b, np.int64)
    for b, n in highest.collect():
        top[b] = n
    parts = stage(map_batches(
        rows.select("row", "pairs", "times"),
        _judge(common, spark.sparkContext.broadcast(top), kind, size_b),
        "row long, pair long, many long, n_best long, count_sum long"), "judged")
    rare = parts.where("pair is not null").select("row", "pair", "many").join(
        counts.where(~many), "pair").join(
        F.broadcast(highest), F.col("pair") % size_b == F.col("b"))
    rare = rare.select("row", F.when(F.col("n") == F.col("highest"), F.col("many")).otherwise(
        0).alias("n_best"), (F.col("many") * F.col("n")).alias("count_sum"))
    sums = parts.where("pair is null").select("row", "n_best", "count_sum").unionByName(
        rare).groupBy("row").agg(F.sum("n_best").alias("n_best"),
                                 F.sum("count_sum").alias("count_sum"))
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"))
