"""Size-aware heavy-light join of shingle sets by Jaccard similarity, as classes of documents.

Two sets of sizes s and t link when 100 * |A & B| >= percent * |A | B|, that is when they
share at least c(s, t) = ceil(percent * (s + t) / (100 + percent)) shingles.

* Equal sets are one class; only one set of a class goes on.
* Light sets (size up to the boundary) write out all their subsets of c(s, t) shingles for
  every size t a partner can have; two sets under one key are a link.
* Heavy sets scan inverted lists. A set can only reach c with a partner that also has one of
  its first s - ceil(percent * s / 100) + 1 shingles in any fixed order of all shingles, so only
  these lists are scanned, in light sets too that are large enough for a heavy partner. The
  order begins with shingles that have an uncommon word and ends with those met in most
  documents (two bounded tables, counted over all documents), so neither common words nor
  a passage in a third of all documents make lists to scan. Any order gives the same links.
* The boundary is the one with the least cost over the sizes found.

Two sets meet in a list only where the shingle stands early enough in both: all they share
stands at their first common shingle or behind it, so at least c(s, t) places must be left in
either set. The shingles of a passage in many documents come last, so a copy with more edits than
may be keeps to the short lists of its own edits. In each round a few leaders of a list, those
with the fewest shingles of their own, are compared with its other sets; links merge classes, and
the list is done when its remaining sets are one class. The least edited copy of a group links
with all that are near enough to meet it, so a group of near copies ends after one round.

Classes are contracted: a round's links join the roots of earlier rounds, no link is read twice.

A candidate that its first shingles do not rule out is checked on the whole texts before it
counts as a link.

Defined results: null and empty texts and texts without words have an empty set and link with
nothing; a null id keeps its count and gets no component; rows with one id are one
document, and links of each of its texts count; very long texts are whole sets, always heavy;
an empty table gives no rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage

from .common import column, distinct, hash_words, map_batches, runs_of, squeeze, unsqueeze
from .components import components

#: Largest size for which subsets are considered, and the cost of a posting in subset keys
#: (a posting is shuffled twice and its candidates are read in full).
MAX_LIGHT, POSTING_COST = 40, 8
#: Shingles in at least this many documents may be put last; the tables of common words and
#: of such shingles have this many entries at most.
OFTEN, TABLE = 64, 1 << 16

#: From this key on, shingles are among those met in most documents.
LAST = np.uint64(2 << 62)


def shingles(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z in lower case."""
    return [distinct(runs_of(w, size)) for w in hash_words(texts)]


def within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


def needed(s: int, t: int, percent: int) -> int:
    return -(-percent * (s + t) // (100 + percent))


def partner_sizes(s: int, percent: int) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def subset_cost(s: int, percent: int) -> int:
    return sum(comb(s, needed(s, t, percent)) for t in partner_sizes(s, percent))


def prefix(s: int, percent: int) -> int:
    """How many first shingles of a set of this size must be looked up."""
    return s - -(-percent * s // 100) + 1


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light size: least cost of subset keys and postings together."""
    def cost(x: int) -> int:
        low = -(-percent * (x + 1) // 100)
        return (sum(n * subset_cost(s, percent) for s, n in sizes.items() if s <= x)
                + POSTING_COST * sum(n * prefix(s, percent) for s, n in sizes.items() if s >= low))
    return min(range(MAX_LIGHT + 1), key=cost)


def common_tables(base: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the commonest words and of the shingles met in most documents, sorted.

    Counted over all documents, block by block; what is rare in a block is not sent.
    """
    def count(texts):
        words = hash_words(texts)
        for kind, parts in ((0, words), (1, [distinct(runs_of(w, size)) for w in words])):
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            some = n >= 4
            yield [[kind] * int(some.sum()), found[some].view(np.int64), n[some]]

    rows = stage(map_batches(base.select("body"), count, "kind int, hash long, n long", 8)
                 .groupBy("kind", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN),
                 "common")
    return tuple(np.sort(np.array(
        [r["hash"] for r in rows.where(F.col("kind") == kind).orderBy(F.desc("n"), "hash")
         .limit(TABLE).collect()], np.int64).view(np.uint64)) for kind in (0, 1))


def ordered(words: np.ndarray, runs: np.ndarray, size: int, common: np.ndarray,
            often: np.ndarray) -> np.ndarray:
    """The shingles as keys in the common order: two bits of rank, then the hash."""
    plain = within(words, common)
    n, span = len(runs), min(size, len(words))
    rank = np.ones(n, np.uint64)
    for k in range(span):
        rank[~plain[k:k + n]] = 0
    rank[within(runs, often)] = 2
    return distinct(runs >> np.uint64(2) | rank << np.uint64(62))


def bitmap(keys: np.ndarray) -> list[int]:
    """256 bits, as four numbers; bit k stands for keys that are k modulo 256."""
    bits = np.zeros(256, np.uint8)
    bits[(keys & np.uint64(255)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _heads(common: np.ndarray, often: np.ndarray, size: int, percent: int):
    def work(ids, texts):
        rows = []
        for doc, words in zip(ids, hash_words(texts), strict=True):
            runs = runs_of(words, size)
            found = distinct(runs)
            n = len(found)
            if not n:
                rows.append((doc, 0, None, [], 0, None, None, []))
                continue
            # Two shingles that share a key only make one more candidate.
            every = ordered(words, runs, size, common, often)
            own = int(np.searchsorted(every, LAST))
            first = every[:prefix(n, percent)]
            # The sign bit is turned so that signed numbers have the order of the keys.
            last = int((first[-1:] ^ np.uint64(1 << 63)).view(np.int64)[0])
            rows.append((doc, n, xxhash.xxh3_128_digest(found.tobytes()),
                         first.view(np.int64).tolist(), own, last, bitmap(first),
                         found.view(np.int64).tolist() if n <= MAX_LIGHT else []))
        yield [list(x) for x in zip(*rows, strict=True)]
    return work


def _subsets(percent: int):
    def work(reps, sets):
        out: tuple[list, ...] = ([], [], [])
        for rep, found in zip(reps, sets, strict=True):
            s = len(found)
            for t in partner_sizes(s, percent):
                pair = np.array([min(s, t), max(s, t)], np.int64).tobytes()
                side = 0 if s == t else 1 if s < t else 2
                for subset in combinations(found, needed(s, t, percent)):
                    data = pair + np.array(subset, np.int64).tobytes()
                    out[0].append(xxhash.xxh3_64_intdigest(data) - 2**63)
                    out[1].append(rep)
                    out[2].append(side)
        yield out
    return work


def light_pairs(light: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of light sets from shared subsets: each set with one of the other size."""
    keys = map_batches(light.select("rep", "all"), _subsets(percent),
                       "key long, rep long, side int")
    least = [F.min(F.when(F.col("side") == k, F.col("rep"))).alias(f"m{k}") for k in range(3)]
    found = keys.groupBy("key").agg(*least, F.count("*").alias("n")).where(
        "n > 1 and (m0 is not null or (m1 is not null and m2 is not null))").drop("n")
    other = F.when(F.col("side") == 0, F.col("m0")).when(
        F.col("side") == 1, F.col("m2")).otherwise(F.col("m1"))
    return keys.join(found, "key").select(F.col("rep").alias("a"), other.alias("b"))


def may_link(percent: int) -> Column:
    """Whether two sets, (n, p, last, bits) and (n2, p2, last2, bits2), can link.

    ``p`` first shingles of each are known by their bits. A shared shingle up to the nearer of
    the two last ones is among both first parts; the set that ends there has n - p others.
    """
    def missed(own: str, other: str) -> Column:
        return sum((F.bit_count(F.col(own)[k].bitwiseAND(F.bitwise_not(F.col(other)[k])))
                    for k in range(4)), F.lit(0))

    shared = F.least(F.col("p") - missed("bits", "bits2"), F.col("p2") - missed("bits2", "bits"))
    rest = F.when(F.col("last") <= F.col("last2"), F.col("n") - F.col("p")).otherwise(
        F.col("n2") - F.col("p2"))
    return (shared + rest) * (100 + percent) >= (F.col("n") + F.col("n2")) * percent


def possible_pairs(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the first shingles do not rule out."""
    one = facts.withColumnRenamed("rep", "a")
    two = facts.select(F.col("rep").alias("b"),
                       *(F.col(c).alias(f"{c}2") for c in ("n", "p", "last", "bits")))
    return pairs.join(one, "a").join(two, "b").where(may_link(percent)).select("a", "b")


def _linked(size: int, percent: int):
    def work(lefts, rights, left_texts, right_texts):
        kept: tuple[list, list] = ([], [])
        # A leader's text stands beside many others: each text of the batch is read once.
        texts = list(dict.fromkeys([*left_texts, *right_texts]))
        sets = dict(zip(texts, shingles([unsqueeze(t) for t in texts], size), strict=True))
        for a, b, x, y in zip(lefts, rights, left_texts, right_texts, strict=True):
            p, q = sets[x], sets[y]
            both = int(np.count_nonzero(within(p, q)))
            if 100 * both >= percent * (len(p) + len(q) - both):
                kept[0].append(a)
                kept[1].append(b)
        yield kept
    return work


def check_pairs(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts link."""
    joined = (pairs.join(texts.select(F.col("rep").alias("a"), F.col("body").alias("left")), "a")
              .join(texts.select(F.col("rep").alias("b"), F.col("body").alias("right")), "b"))
    return map_batches(joined.select("a", "b", "left", "right"), _linked(size, percent),
                       "a long, b long")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered.where("a <> b").groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of the classes ``roots`` after these links as well; nodes without a link are
    not listed. Only the new links and the roots they join are gone through."""
    if links.isEmpty():
        return links.sparkSession.createDataFrame([], "node long, root long") if (
            roots is None) else roots
    if roots is None:
        return components(links)
    ends = {side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
            for side in "ab"}
    joined = links.join(ends["a"], "a", "left").join(ends["b"], "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    # A root of earlier rounds, or a node that had no link, and its root from now on.
    after = components(joined).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(after, F.col("root") == F.col("old"), "left").select(
        "node", F.coalesce("new", "root").alias("root"))
    added = after.join(roots, F.col("old") == F.col("node"), "left_anti").select(
        F.col("old").alias("node"), F.col("new").alias("root"))
    return stage(moved.unionByName(added), "roots")


def enough(percent: int) -> Column:
    """Whether a list's shingle stands early enough in both of its sets."""
    c = F.expr(f"((n + n2) * {percent} + {99 + percent}) div {100 + percent}")
    return (F.col("n") - F.col("pos") >= c) & (F.col("n2") - F.col("pos2") >= c)


def join_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3,
                 percent: int = 90) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the least id reachable by links."""
    base = docs.select(column(docs, id, "long").alias("doc_id"),
                       column(docs, text, "binary").alias("body"))
    common, often = common_tables(base, size)
    heads = stage(map_batches(
        base, _heads(common, often, size, percent),
        "doc_id long, n long, key binary, first array<long>, own int, last long, "
        "bits array<long>, "
        "all array<long>"), "heads")
    sets = heads.where("n > 0 and doc_id is not null")
    classes = stage(sets.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = sets.join(classes, "key").where("doc_id = rep")

    # At most MAX_LIGHT + 1 counts and one for the rest matter for the boundary.
    rows = chosen.where(F.col("n") <= 2 * MAX_LIGHT).groupBy("n").count().collect()
    x = boundary({r["n"]: r["count"] for r in rows}, percent)
    lowest = -(-percent * (x + 1) // 100)
    postings = chosen.where(F.col("n") >= lowest).select(
        F.posexplode("first").alias("pos", "shingle"), "rep", F.col("n").cast("int").alias("n"),
        "own")
    shared = postings.groupBy("shingle").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    lists = stage(postings.join(shared.where("lo < hi").select("shingle"), "shingle")
                  .withColumn("root", F.col("rep")), "lists")

    facts = stage(chosen.where(F.col("n") >= lowest).select(
        "rep", F.col("n").cast("int").alias("n"), F.size("first").alias("p"), "last", "bits"), "facts")

    pairs = distinct_pairs(light_pairs(chosen.where(F.col("n") <= x), percent))
    pairs = stage(pairs, "pairs")
    wanted = lists.select("rep").unionByName(pairs.select(F.col("a").alias("rep"))).unionByName(
        pairs.select(F.col("b").alias("rep"))).distinct()
    texts = stage(map_batches(
        base.join(wanted, base["doc_id"] == wanted["rep"]).select("rep", "body"),
        lambda reps, bodies: iter([(reps, [squeeze(b or b"") for b in bodies])]),
        "rep long, body binary"), "texts")
    checked, leaders = pairs, 1
    links = stage(check_pairs(pairs, texts, size, percent), "links")
    roots = merged(None, links)
    while True:
        # Lists whose sets are not yet one class, each with its leaders: of each slice the set with
        # the fewest shingles of its own. All their pairs are tried, so they leave the list.
        named = lists.drop("root").join(
            roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "root", F.coalesce("root", "rep"))
        state = named.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        lists = stage(named.join(state.where("lo < hi").select("shingle"), "shingle"), "lists")
        if lists.isEmpty():
            break
        sliced = lists.withColumn("slice", F.pmod(F.xxhash64("rep", "shingle"), F.lit(leaders)))
        lead = sliced.groupBy("shingle", "slice").agg(F.min(F.struct("own", "rep")).alias(
            "least")).select("shingle", F.col("least.rep").alias("rep"))
        second = lists.join(lead, ["shingle", "rep"]).select(
            "shingle", *(F.col(c).alias(f"{c}2") for c in ("rep", "n", "pos", "root")))
        tried = lists.join(second, "shingle").where(
            (F.col("root") != F.col("root2")) & enough(percent)
            & (F.greatest("n", "n2") * percent <= F.least("n", "n2") * 100))
        new = distinct_pairs(tried.select(F.col("rep").alias("a"), F.col("rep2").alias("b")))
        new = possible_pairs(new, facts, percent)
        new = stage(new.join(checked, ["a", "b"], "left_anti"), "pairs")
        found = stage(check_pairs(new, texts, size, percent), "links")
        checked = checked.unionByName(new)
        roots = merged(roots, found)
        lists = lists.join(lead, ["shingle", "rep"], "left_anti")
        leaders *= 16
    # Set -> class -> component; a hot class is many rows of a join.
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", F.coalesce("root", "rep").alias("component_id"))
    linked = sets.select("doc_id", "n", "key").join(named, "key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = heads.where("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
