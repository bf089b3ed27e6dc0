"""Near duplicates among embeddings: cross-polytope hashing with multiprobe buckets.

*Hashing.* A vector is padded to a power of two, rotated by three rounds of random signs and a
fast Hadamard transform, and hashed to the axis (with its sign) that it lies closest to. A
bucket joins a few such hashes, as many as it takes for about as many buckets as vectors. Each
of several tables files a vector once, under its own bucket, and looks it up there and in the
buckets that the nearest other axes would give. The number of tables follows from the chance,
measured on random pairs at the very limit of similarity, that a table finds a pair.

*Verification.* The cosine of every candidate pair is computed from the vectors in double
precision, tile by tile as matrix products. Pairs never become rows: a tile tells per vector
how many new links it has and its tree within the tile. A pair that several buckets hold is
counted where it would be found first, which both vectors' buckets tell, so no pair is counted
twice or gathered to be made distinct.

*Groups of any size.* Equal vectors are one class with a number of copies and are hashed once.
A bucket with more than ``TILE`` rows is dealt to several chunks, and each two of them meet in a
tile of their own. Its pairs are still all looked at (each of them may or may not be a link), so
work, not memory, grows with the square of a group of different near copies.

Defined results: vectors that are null or empty, hold null or non-finite components, or are
zero link with nothing (also not with equal ones). Vectors of different lengths never link.
Rows with one id are vectors of their own. Rows without id count as links of others;
a component's id is the least that is there, null where none is, and then nothing is kept. An
empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.hot_join import hot_join
from tallyspark.session import stage

from .common import map_batches
from .components import components

SIMILAR = 0.9
#: Share of the pairs at the very limit that are to be found; others are found more often.
RECALL = 0.99
#: Other buckets that a vector is looked up in, per table, and axes tried for each hash.
PROBES, AXES = 3, 4
#: Rows of a bucket that meet in one task.
TILE = 1024
#: Buckets known to be large, up to which they are sent to every task.
SHORT = 100_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their length, a power of two."""
    size, half = x.shape[1], 1
    while half < size:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]],
                     axis=2).reshape(len(x), size)
        half *= 2
    return x


@cache
def _signs(size: int, hashes: int) -> np.ndarray:
    return np.random.default_rng([size, 13]).choice([-1.0, 1.0], (hashes, 3, size))


class Hasher:
    """``tables`` buckets of ``joined`` hashes each for vectors of one length."""

    def __init__(self, length: int, joined: int, tables: int, probes: int = PROBES):
        self.size = 1 << max(1, (length - 1).bit_length())
        self.joined, self.tables, self.probes = joined, tables, probes
        axes = min(AXES, 2 * self.size)
        steps = np.array(sorted(product(range(axes), repeat=joined), key=lambda c: (sum(c), c)))
        # Combinations beyond these have nearer ones before them, whatever the vector.
        self.steps = steps[steps.sum(axis=1) <= probes][1:]
        self.axes = axes

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes): the own bucket first, then the next best.

        Only sums and comparisons of a vector's own numbers, so the same vector has the same
        keys in every batch.
        """
        x = np.pad(x, ((0, 0), (0, self.size - x.shape[1])))
        signs = _signs(self.size, self.tables * self.joined)
        width = 2 * self.size
        out = np.zeros((len(x), self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            axes, loss = [], []
            for k in range(self.joined):
                y = x
                for sign in signs[t * self.joined + k]:
                    y = hadamard(y * sign)
                both = np.concatenate([y, -y], axis=1)
                best = np.argsort(-both, axis=1, kind="stable")[:, :self.axes]
                far = np.take_along_axis(both, best, 1)
                axes.append(best)
                loss.append(((far[:, :1] - far) / np.sqrt(
                    np.maximum((y * y).sum(axis=1, keepdims=True), 1e-300))) ** 2)
            home = np.zeros(len(x), np.int64)
            for best in axes:
                home = home * width + best[:, 0]
            out[:, t, 0] = home
            if self.probes:
                cost = sum(part[:, self.steps[:, k]] for k, part in enumerate(loss))
                chosen = self.steps[np.argsort(cost, axis=1, kind="stable")[:, :self.probes]]
                probe = np.zeros(chosen.shape[:2], np.int64)
                for k, best in enumerate(axes):
                    probe = probe * width + np.take_along_axis(best, chosen[:, :, k], 1)
                out[:, t, 1:1 + probe.shape[1]] = probe
                out[:, t, 1 + probe.shape[1]:] = -1
        return out


def found(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of keys (pairs, tables, keys): whether each table finds the pair in the bucket
    of the first vector, and in that of the second."""
    same = x[:, :, 0] == y[:, :, 0]
    return (same | (x[:, :, :1] == y[:, :, 1:]).any(axis=2),
            same | (y[:, :, :1] == x[:, :, 1:]).any(axis=2))


@cache
def chance(length: int, joined: int, probes: int = PROBES, similar: float = SIMILAR,
           pairs: int = 4000) -> float:
    """Share of random pairs with a cosine of ``similar`` that one table finds."""
    rng = np.random.default_rng([length, joined, 7])
    x, z = rng.standard_normal((2, pairs, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = similar * x + math.sqrt(1 - similar ** 2) * z
    hasher = Hasher(length, joined, 1, probes)
    here, there = found(hasher.keys(x), hasher.keys(y))
    return float((here | there).mean())


def plan(length: int, vectors: int, recall: float = RECALL, probes: int = PROBES) -> Hasher:
    """Hashes per bucket for about one vector a bucket, tables for the recall at the limit."""
    size = 1 << max(1, (length - 1).bit_length())
    joined = max(1, min(6, round(math.log(max(2, vectors)) / math.log(2 * size))))
    once = min(0.999, max(chance(length, joined, probes), 1e-3))
    return Hasher(length, joined, max(1, math.ceil(math.log(1 - recall) / math.log(1 - once))),
                  probes)


def usable(vector: Column) -> Column:
    """Finite components all of them, and one other than zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _scaled(vectors: list[bytes]) -> np.ndarray:
    """Rows divided by their largest component, so that no square overflows."""
    x = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _filing(hashers: dict[int, Hasher]):
    def work(node, copies, embedding):
        by_length: dict[int, list[int]] = {}
        for k, x in enumerate(embedding):
            by_length.setdefault(len(x), []).append(k)
        for length, some in by_length.items():
            vectors = [np.array(embedding[k], "<f8").tobytes() for k in some]
            hasher = hashers[length]
            keys = hasher.keys(_scaled(vectors))
            for t in range(hasher.tables):
                here = keys[:, t]
                at, probe = np.nonzero(here >= 0)
                yield ([length] * len(at), [t] * len(at), here[at, probe].tolist(),
                       (probe == 0).tolist(), [node[some[k]] for k in at],
                       [copies[some[k]] for k in at], [vectors[k] for k in at])

    return work


FILED = ("length int, table int, bucket long, home boolean, node long, copies long, "
         "vector binary")
LEFT, RIGHT = 1, 2


def tiles(filed: DataFrame, tile: int = TILE) -> DataFrame:
    """(length, table, bucket, a, b, members): every two chunks of a bucket meet in one row.

    A member is on the left of a tile (vectors filed there), on its right (those filed or looked
    up there) or on both sides of the one tile of an ordinary bucket.
    """
    key = ["length", "table", "bucket"]
    sizes = filed.groupBy(*key).agg(F.count("*").alias("rows"),
                                    F.count_if("home").alias("homes"))
    large = stage(sizes.where((F.col("rows") > tile) & (F.col("homes") > 0)).select(
        *key, F.ceil(F.col("rows") / F.lit(tile)).cast("int").alias("chunks")), "large")
    if large.limit(SHORT + 1).count() <= SHORT:
        known = filed.join(F.broadcast(large), key, "left")
    else:
        known = hot_join(filed, large, key)
    n = F.coalesce("chunks", F.lit(1))
    chunk = F.pmod(F.xxhash64("node"), n).cast("int")
    member = known.select(*key, "home", "node", "copies", "vector", n.alias("n"),
                          chunk.alias("c"))
    spot = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"),
                                       side.cast("int").alias("side"))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    c, home = F.col("c"), F.col("home")
    # As left: with every chunk; as right: with every chunk for rows looked up, and with those
    # up to its own for rows filed, so that two rows filed meet once.
    left = F.when(home, F.transform(every, lambda b: spot(
        c, b, F.when(b == c, LEFT + RIGHT).otherwise(LEFT))))
    right = F.transform(F.filter(every, lambda a: ~home | (a < c)),
                        lambda a: spot(a, c, F.lit(RIGHT)))
    placed = member.withColumn("spot", F.explode(F.concat(
        F.coalesce(left, F.array().cast("array<struct<a:int,b:int,side:int>>")), right)))
    grouped = placed.groupBy(*key, F.col("spot.a").alias("a"), F.col("spot.b").alias("b")).agg(
        F.collect_list(F.struct("node", "copies", "home", F.col("spot.side").alias("side"),
                                "vector")).alias("members"))
    return grouped.where(F.size("members") > 1)


def _roots(size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least place in each place's component of the links x - y."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _verify(hashers: dict[int, Hasher], similar: float, block: int = 200_000):
    def one(length, table, bucket, a, b, members):
        nodes = np.array([m["node"] for m in members])
        copies = np.array([m["copies"] for m in members])
        home = np.array([m["home"] for m in members])
        side = np.array([m["side"] for m in members])
        left, right = np.flatnonzero(side & LEFT), np.flatnonzero(side & RIGHT)
        if not len(left) or not len(right):
            return
        x = _scaled([m["vector"] for m in members])
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        close = unit[left] @ unit[right].T >= similar - 1e-9
        close &= nodes[left][:, None] != nodes[right][None, :]
        if a == b:  # rows filed here meet both ways round
            close &= ~home[right][None, :] | (nodes[left][:, None] < nodes[right][None, :])
        p, q = np.nonzero(close)
        if not len(p):
            return
        p, q = left[p], right[q]
        which, place = np.unique(np.concatenate([p, q]), return_inverse=True)
        keys = hashers[length].keys(x[which])
        s, t = place[:len(p)], place[len(p):]
        counted = np.zeros(len(p), bool)
        for k in range(0, len(p), block):
            part = slice(k, k + block)
            # The products above may differ in the last place; this sum does not.
            exact = (unit[p[part]] * unit[q[part]]).sum(axis=1) >= similar
            kx, ky = keys[s[part]], keys[t[part]]
            in_x, in_y = found(kx, ky)
            first = (in_x | in_y).argmax(axis=1)
            row = np.arange(len(first))
            most = np.iinfo(np.int64).max
            least = np.minimum(np.where(in_x[row, first], kx[row, first, 0], most),
                               np.where(in_y[row, first], ky[row, first, 0], most))
            counted[part] = exact & (first == table) & (least == bucket)
        s, t = s[counted], t[counted]
        if not len(s):
            return
        own, many = nodes[which], copies[which]
        links = np.bincount(s, many[t], len(which)) + np.bincount(t, many[s], len(which))
        root = _roots(len(which), s, t)
        linked = np.flatnonzero(links)
        yield own[linked], links[linked].astype(np.int64), own[root[linked]]

    def work(length, table, bucket, a, b, members):
        out: list[list] = [[], [], []]
        for row in zip(length, table, bucket, a, b, members, strict=True):
            for part in one(*row):
                for values, more in zip(out, part, strict=True):
                    values.extend(more.tolist())
        yield tuple(out)

    return work


def near_duplicates(vectors: DataFrame, similar: float = SIMILAR, recall: float = RECALL,
                    probes: int = PROBES, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding)``."""
    cells = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                                F.when(usable(cells), cells).alias("embedding")).withColumn(
        "row", F.monotonically_increasing_id()), "vectors")
    classes = stage(rows.where("embedding is not null").groupBy("embedding").agg(
        F.min("row").alias("node"), F.count("*").alias("copies"),
        F.min("vec_id").alias("least")), "classes")
    lengths = {r["n"]: r["vectors"] for r in classes.groupBy(
        F.size("embedding").alias("n")).agg(F.count("*").alias("vectors")).collect()}
    hashers = {n: plan(n, many, recall, probes) for n, many in lengths.items()}
    filed = stage(map_batches(classes.select("node", "copies", "embedding"), _filing(hashers),
                              FILED), "filed")
    links = stage(map_batches(tiles(filed, tile), _verify(hashers, similar),
                              "node long, links long, root long"), "links")
    count = links.groupBy("node").agg(F.sum("links").alias("links"))
    trees = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = stage(classes.join(count, "node", "left").join(trees, "node", "left").select(
        "embedding", "node", "copies", "links", "least",
        F.coalesce("root", "node").alias("root")), "linked")
    # A component, like a class, may hold a third of all rows.
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = hot_join(linked, least, ["root"], "inner").select(
        "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "component_id")
    return hot_join(rows, known, ["embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("embedding").isNull(), F.col("vec_id")).otherwise(
            F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(F.col("embedding").isNull(), F.col("vec_id").isNotNull()).otherwise(
            F.col("vec_id") == F.col("component_id")), F.lit(False)).alias("kept"))
