"""Quality rules: lines that many documents of one host show are removed; what is left decides.

A line is compared by the hash of its lower-cased words. Per host, the distinct documents that
show it are counted, wherever it stands in them: rows with the same whole text are one document,
rows that differ anywhere are several. A line above the host's limit is boilerplate there, however
much of a document it makes up, and a document that loses too much with it is rejected. So near
copies of one article are rejected together only where they are more than the limit of their host.

Defined results: a null text has no words; a null host is the host with the empty name; repeated
rows are judged one by one and count once; very long texts and lines are counted and cut like
others; an empty table gives no rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage

from .common import column, map_batches, words_of

#: A line is boilerplate in more than this share of a host's documents, and more than this many.
MAX_SHARE, MIN_DOCUMENTS = 0.05, 20
#: A document is depleted if it keeps less than this share of its words or fewer words than this.
MIN_LEFT, MIN_WORDS = 0.5, 10
#: Boilerplate lines (eight bytes each) that are sent to every executor at most.
BROADCAST_LINES = 500_000

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, n_lines_removed long, "
          "n_words_removed long, kept boolean, text string")
SYMBOLS = re.compile(rb"[#*$%&|<>]")


def line_key(line: bytes) -> int:
    """Signed 64-bit hash of the lower-cased words of a line; 0 where it has none."""
    words = line.decode(errors="replace").lower().encode().split()
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).view(np.int64)) if words else 0


def _shown(hosts: list, texts: list):
    """Host, line and how many of the documents show it."""
    shows: Counter = Counter()
    for host, text in zip(hosts, texts, strict=True):
        shows.update({(host, k) for k in map(line_key, (text or b"").split(b"\n")) if k})
    yield [[h for h, _ in shows], [k for _, k in shows], list(shows.values())]


def _showing(hosts: list, texts: list, candidates: list):
    """Host, candidate line and the digest of a text that shows it."""
    out: tuple[list, ...] = ([], [], [])
    for host, text, some in zip(hosts, texts, candidates, strict=True):
        shown = {line_key(line) for line in text.split(b"\n")} & set(some)
        digest = int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64)) if shown else 0
        for key in shown:
            for values, x in zip(out, (host, key, digest), strict=True):
                values.append(x)
    yield out


def _sent(lines: DataFrame) -> DataFrame:
    """Broadcast while the lines are few, so texts stay where they are; beyond that Spark sorts
    both sides by host and splits a hot one."""
    few = (lines.agg(F.sum(F.size("lines"))).first()[0] or 0) <= BROADCAST_LINES
    return F.broadcast(lines) if few else lines


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source",
                   max_share: float = MAX_SHARE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row per host with boilerplate: the host and its lines' hashes.

    A host has at most 1 / max_share times as many of them as lines in a mean document.
    """
    base = docs.select(F.coalesce(column(docs, host, "string"), F.lit("")).alias("host"),
                       column(docs, text, "binary").alias("body"))
    sizes = base.groupBy("host").agg(F.count("*").alias("size"))

    def above(shows: DataFrame) -> DataFrame:
        return (shows.where(F.col("n") > min_documents).join(sizes, "host")
                .where(F.col("n") > F.col("size") * max_share)
                .groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")))

    # All rows first: with copies counted once, only lines above the limit here can stay so.
    shown = map_batches(base, _shown, "host string, line long, n long")
    candidates = _sent(stage(above(shown.groupBy("host", "line").agg(F.sum("n").alias("n"))),
                             "candidates"))
    showing = map_batches(base.where("body is not null").join(candidates, "host").select(
        "host", "body", "lines"), _showing, "host string, line long, digest long")
    return above(showing.groupBy("host", "line", "digest").agg(F.lit(1).alias("one"))
                 .groupBy("host", "line").agg(F.count("*").alias("n")))


def repeat_words(ids: np.ndarray, size: int = 5) -> int:
    """Words inside a window of ``size`` words that occurs at least twice."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    code = ids[:n]
    for k in range(1, size):
        # Ranks instead of hashes: two windows share a code only if they are equal.
        code = code * len(ids) + ids[k:k + n]
        if k == 2 or k == size - 1 or len(ids) > 2_000_000:
            code = np.unique(code, return_inverse=True)[1]
    often = np.bincount(code)[code] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += often
    edge[size:] -= often
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in them, symbols, repeated lines, words in repeated windows."""
    words = words_of(text)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), int(np.count_nonzero(raw & 0xC0 != 0x80)), len(SYMBOLS.findall(text)),
            len(lines) - len(set(lines)), repeat_words(ids))


def _judge(min_left: float, min_words: int):
    def work(ids: list, texts: list, drops: list, *carried: list):
        rows = []
        for doc, text, drop in zip(ids, texts, drops, strict=True):
            text = text or b""
            counts = base_counts(text)
            n, failed = counts[0], counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
            lines, left, gone = text.split(b"\n"), n, 0
            if drop:
                drop = set(drop)
                stay = [x for x in lines if line_key(x) not in drop]
                gone = len(lines) - len(stay)
                text = b"\n".join(stay)
                left = len(words_of(text)) if gone else n
            depleted = gone > 0 and (left < min_words or left < min_left * n)
            rows.append((doc, *counts, failed, gone, n - left, not failed and not depleted,
                         text.decode(errors="replace")))
        yield [*(list(x) for x in zip(*rows, strict=True)), *carried]
    return work


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source",
          max_share: float = MAX_SHARE, min_documents: int = MIN_DOCUMENTS,
          min_left: float = MIN_LEFT, min_words: int = MIN_WORDS,
          carry: list[str] | None = None) -> DataFrame:
    """Counts, verdict and the text without boilerplate lines, one row per input row.

    Columns of the input named in ``carry`` are handed on as text.
    """
    carry = carry or []
    drops = _sent(stage(frequent_lines(docs, text, host, max_share, min_documents), "lines"))
    base = docs.select(column(docs, id, "long").alias("doc_id"),
                       column(docs, text, "binary").alias("body"),
                       F.coalesce(column(docs, host, "string"), F.lit("")).alias("host"),
                       *(column(docs, c, "string").alias(f"c_{c}") for c in carry))
    joined = base.join(drops, "host", "left").select(
        "doc_id", "body", "lines", *(f"c_{c}" for c in carry))
    extra = "".join(f", `{c}` string" for c in carry)
    return map_batches(joined, _judge(min_left, min_words), SCHEMA + extra)
