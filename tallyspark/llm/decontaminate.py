"""Benchmark decontamination: CGK embedding of anchored parts, exact edit distance.

CGK reads a sequence by a random walk: at step j it puts out the symbol under the cursor and
moves the cursor on by a random bit that depends on (j, symbol); past the end it puts out
nothing. Symbols are words between blanks, lower case, without the marks around them.

At the edit limit a walk over a whole item has little in common with that of its edited copy.
So an item of n words that may have k edits is cut into k + 1 parts: in every window within the
limit at least one part is left whole, wherever the edits are. The walk over a part reads no
word outside it, so a whole part always has the part's hash, and no match is missed.

All windows of a text are embedded at once. The value of step j at every position follows
from step j + 1 at the same and at the next position, so a walk costs a few vector operations
per step and word of a part over the whole batch, not a walk per window.

Where a part's hash is met, the item is aligned with the text around it, free at both ends of
the window, and a pair counts if the edits are at most ``max_edit`` of the item's words.

Defined results: null and empty texts and items match nothing; repeated rows give repeated
results; null ids are returned as null; an item without words is ignored. Very long texts are
searched whole; empty tables of either kind give no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column, map_batches, remembered, words_of

MAX_EDIT = 0.2
#: Items are compared in blocks of this many, so no closure grows with the benchmark.
BLOCK = 5000
#: A part is read by a walk over this many of its words: the most that it has.
READ = (1, 2, 3, 4, 6, 8, 12)
MARKS = re.compile(r"^[\W_]+|[\W_]+$")
SCHEMA = "doc_id long, item_id long, start long, edits long, item_words long"


class Symbols(WordHashes):
    """Word to 32-bit symbol; the marks around a word do not count, 0 stands for no word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        bare = MARKS.sub("", word.decode(errors="replace").lower()) or "."
        self[word] = value = xxhash.xxh32_intdigest(bare.encode()) or 1
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


#: The words met so far; a Python worker keeps them from task to task.
SYMBOLS = Symbols()
remembered(__name__, SYMBOLS.clear)


class Walk:
    """One random walk over parts of so many words, of two steps a word."""

    SPAN = 1 << 14  # positions at a time, so that a step stays inside the processor's cache

    def __init__(self, seed: int, words: int) -> None:
        self.salt = np.uint32(np.random.default_rng(seed).integers(1, 2**32))
        self.words = words

    def hashes(self, symbols: np.ndarray) -> np.ndarray:
        """The hash of the walk over the part at each position; past the end stand zeros."""
        padded = np.concatenate([symbols, np.zeros(self.words, np.uint32)])
        out = np.empty(len(symbols), np.uint32)
        for a in range(0, len(symbols), self.SPAN):
            part = padded[a:a + self.SPAN + self.words]
            out[a:a + self.SPAN] = self._part(part)[:len(part) - self.words]
        return out

    def _part(self, symbols: np.ndarray) -> np.ndarray:
        # Bit j of a symbol's draw says whether step j moves the cursor on.
        draw = (symbols ^ self.salt) * np.uint32(0x9E3779B1)
        draw ^= draw >> np.uint32(15)
        draw *= np.uint32(0x85EBCA77)
        draw ^= draw >> np.uint32(13)
        # Of the walk from here on, with the cursor on each position as the part's word so and so.
        value = np.zeros((self.words + 1, len(symbols)), np.uint32)
        bit = np.empty(len(symbols), np.uint32)
        for j in range(2 * self.words - 1, -1, -1):
            np.bitwise_and(draw, np.uint32(1 << j), out=bit)
            moves = bit[:-1].astype(bool)
            for word in range(min(self.words, j + 1)):
                now = value[word]
                np.copyto(now[:-1], value[word + 1, 1:], where=moves)
                now += symbols
                now *= np.uint32(0xC2B2AE3D)
                now ^= now >> np.uint32(16)
        return value[0]


def edit_distance(item: np.ndarray, window: np.ndarray, limit: int) -> int:
    """Least edits that turn the item into some beginning of the window; limit + 1 if more."""
    n = min(len(window), len(item) + limit)
    same = min(len(item), n)
    if same == len(item) and np.array_equal(item, window[:same]):
        return 0
    steps = np.arange(n + 1)
    row = steps.copy()
    for k, symbol in enumerate(item):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[:-1] + (window[:n] != symbol), row[1:] + 1)
        # Insertions: the least of new[i] + (j - i) over i <= j.
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > limit:
            return limit + 1
    return int(min(row.min(), limit + 1))


def best_window(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int]:
    """Least edits that turn the item into a window of the text, and the first such window's
    start; limit + 1 edits if more."""
    # Read backwards, the last row has the least edits of the windows that start at each place.
    symbols = text[::-1]
    steps = np.arange(len(symbols) + 1)
    row = np.zeros(len(symbols) + 1, np.int64)
    for k, symbol in enumerate(item[::-1]):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[:-1] + (symbols != symbol), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > limit:
            return limit + 1, 0
    edits = int(row.min())
    return edits, len(symbols) - int(np.flatnonzero(row == edits)[-1])


def parts_of(length: int, limit: int) -> list[tuple[int, int]]:
    """Start and words read of limit + 1 parts of so many words, each word in one part."""
    cuts = [length * k // (limit + 1) for k in range(limit + 2)]
    return [(a, max(w for w in READ if w <= b - a)) for a, b in itertools.pairwise(cuts)]


class Index:
    """The parts of all items by the words read of them, and where they lie in their items."""

    BITS = 20  # of a hash, looked up before the hash itself

    def __init__(self, items: list[tuple[int, str]], max_edit: float) -> None:
        self.items = []
        parts: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            symbols = SYMBOLS.of(words_of((text or "").encode()))
            if len(symbols):
                # A limit of as many edits as words would be met by any text.
                limit = min(int(max_edit * len(symbols)), len(symbols) - 1)
                for start, words in parts_of(len(symbols), limit):
                    parts.setdefault(words, []).append((len(self.items), start))
                self.items.append((item_id, symbols, limit))
        self.groups = []
        for words, members in sorted(parts.items()):
            walk = Walk(xxhash.xxh3_64_intdigest(f"{words}".encode()), words)
            under: dict[int, list[tuple[int, int]]] = {}
            of_item = {i: walk.hashes(self.items[i][1]) for i in {i for i, _ in members}}
            for i, start in members:
                under.setdefault(int(of_item[i][start]), []).append((i, start))
            few = np.zeros(1 << self.BITS, bool)
            few[[h & (1 << self.BITS) - 1 for h in under]] = True
            self.groups.append((walk, under, few))

    def matches(self, symbols: np.ndarray, starts: np.ndarray,
                ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, position) of the places in texts that are within an item's limit;
        the texts lie between these positions."""
        places: dict[int, list[int]] = {}
        for walk, under, few in self.groups:
            values = walk.hashes(symbols)
            at = np.flatnonzero(few[values & np.uint32((1 << self.BITS) - 1)])
            for p, h in zip(at.tolist(), values[at].tolist(), strict=True):
                for i, start in under.get(h, ()):
                    places.setdefault(i, []).append(p - start)
        for i, found in places.items():
            _, item, limit = self.items[i]
            near = self._hold(symbols, np.unique(found), item, limit)
            # Places that a few edits may shift into one another are aligned together.
            for some in np.split(near, np.flatnonzero(np.diff(near) > limit) + 1):
                if len(some):
                    d = int(np.searchsorted(starts, some[0] + len(item), "right")) - 1
                    a = max(int(some[0]) - limit, int(starts[d]))
                    b = min(int(some[-1]) + len(item) + limit, int(ends[d]))
                    edits, first = best_window(item, symbols[a:b], limit)
                    if edits <= limit:
                        yield d, i, edits, a + first

    @staticmethod
    def _hold(symbols: np.ndarray, places: np.ndarray, item: np.ndarray,
              limit: int) -> np.ndarray:
        """The places around which enough words of the item stand for the limit."""
        distinct = np.unique(item)
        needed = len(distinct) - limit
        kept = []
        for part in np.array_split(places, len(places) // 4096 + 1):
            spread = part[:, None] + np.arange(-limit, len(item) + limit)
            words = symbols[np.clip(spread, 0, len(symbols) - 1)]
            where = np.searchsorted(distinct, words)
            where[where == len(distinct)] = 0
            held = distinct[where] == words
            found = np.zeros((len(part), len(distinct)), bool)
            found[np.nonzero(held)[0], where[held]] = True
            kept.append(part[found.sum(1) >= needed])
        return np.concatenate(kept)


def _search(items: list[tuple[int, str]], max_edit: float):
    made: list[Index] = []

    def work(ids: list, texts: list):
        if not made:
            made.append(Index(items, max_edit))
        index = made[0]
        longest = max((len(s) for _, s, _ in index.items), default=0)
        gap = np.zeros(3 * longest + 1, np.uint32)  # no window reaches the next text
        parts, starts, ends, total = [gap], [], [], len(gap)
        for text in texts:
            starts.append(total)
            part = SYMBOLS.of(words_of(text))
            parts += [part, gap]
            ends.append(total + len(part))
            total += len(part) + len(gap)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if index.items:
            for d, i, edits, p in index.matches(np.concatenate(parts), np.array(starts),
                                                np.array(ends)):
                best[d, i] = min(best.get((d, i), (edits, p)), (edits, p))
        rows = [(ids[d], index.items[i][0], p - starts[d], edits, len(index.items[i][1]))
                for (d, i), (edits, p) in sorted(best.items())]
        yield [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 5

    return work


def item_blocks(items: DataFrame, id: str, text: str, block: int) -> Iterator[list]:
    """The items in blocks of a fixed size, in the order of their ids."""
    rows = items.select(column(items, id, "long").alias("item_id"),
                        column(items, text, "string").alias("item_text"))
    found: list[tuple[int, str]] = []
    for row in rows.orderBy("item_id", "item_text").toLocalIterator():
        found.append((row["item_id"], row["item_text"]))
        if len(found) == block:
            yield found
            found = []
    yield found


def contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", max_edit: float = MAX_EDIT,
                 block: int = BLOCK) -> DataFrame:
    """One row per row of documents and item found in it: the place (word number) of the best
    match and its edits. No shuffle; the documents are read once per block of items."""
    base = docs.select(column(docs, id, "long").alias("doc_id"),
                       column(docs, text, "binary").alias("body"))
    out = None
    for found in item_blocks(items, item_id, item_text, block):
        part = map_batches(base, _search(found, max_edit), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out
