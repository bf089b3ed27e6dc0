"""The k nearest customers of many anchors, exactly, without anchors times customers.

Customers that coincide are one point. Points are dealt to cells, the leaves of a tree of cuts, and
a cell knows the box its points lie in. With x at a distance d from the box and r the greatest
length of a point in it, no dot product of x there exceeds (|x|^2 + r^2 - d^2) / 2. So the best of
an anchor's own cell give a bound, and only cells that can reach it are looked at afterwards. A cell
with many points is several chunks, and its anchors are several parts; each (chunk, part) is a
matrix of bounded size in one task, of which every anchor keeps its best. Which customers the points
stand for is looked up at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import half_even
from ..session import stage
from .clusters import SCALED
from .lookalikes import unit_columns

#: Points of a cell, and anchors, that meet in one task; points a cell should have; most cells,
#: and the points per cell that choose the cuts.
CHUNK, LEAF, CELLS, DRAWN = 10_000, 1024, 4096, 16
#: Numbers of a matrix that stays in a core's cache.
TILE = 1 << 17
UNITS = [f"u{i}" for i in range(len(SCALED))]
_KINDS = ", ".join(f"{u} double" for u in UNITS)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products, added up column by column like the column expression."""
    total = a[:, :1] * b[:, 0]
    for k in range(1, a.shape[1]):
        total += a[:, k:k + 1] * b[:, k]
    return total


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.column_stack([table.column(u).to_numpy(zero_copy_only=False) for u in UNITS])


def _cuts(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, value) of a full tree in the order of a heap: each cut halves the points along the
    column in which they lie farthest apart. A cut at infinity sends all to the left."""
    column, value = np.zeros(cells - 1, np.int64), np.full(cells - 1, np.inf)
    held = [points]
    for at in range(cells - 1):
        some = held[at]
        held[at] = points[:0]
        spread = np.ptp(some, axis=0) if len(some) else np.zeros(points.shape[1])
        column[at] = spread.argmax()
        line = some[:, column[at]]
        if spread.max() > 0:
            middle = np.partition(line, len(line) // 2)[len(line) // 2]
            value[at] = middle if middle > line.min() else line[line > middle].min()
        held += [some[line < value[at]], some[~(line < value[at])]]
    return column, value


def _home(x: np.ndarray, column: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The cell that each row lies in."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range((len(column) + 1).bit_length() - 1):
        at = 2 * at + 1 + ~(x[rows, column[at]] < value[at])
    return at - len(column)


def _celled(points: DataFrame, cuts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(point, first, units) with their cell."""

    def run(batches):
        for batch in batches:
            cell = _home(_matrix(batch), *cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))],
                                             names=[*batch.schema.names, "cell"])

    return points.select("point", "first", *UNITS).mapInArrow(
        run, f"point long, first string, {_KINDS}, cell int")


def _best(k: int):
    """Per anchor the k best points of one chunk of a cell that reach its bound, ties by the least
    id of a point."""

    def work(anchors: pa.Table, members: pa.Table) -> pa.Table:
        # Points stand in the order of their ids, so the first of equals are taken.
        members = members.take(pc.sort_indices(members.column("first")))
        x, y = _matrix(anchors), _matrix(members)
        names, points = anchors.column("anchor").to_numpy(), members.column("point").to_numpy()
        bounds = anchors.column("bound").to_numpy(zero_copy_only=False).astype(float)
        some, step = min(k, len(y)), max(1, TILE // max(1, len(y)))
        rows, cols, exact = [], [], []
        for at in range(0, len(x) if len(y) else 0, step):
            dots = _dots(x[at:at + step], y)
            least = bounds[at:at + step].copy()
            new = np.isnan(least)
            if new.any():
                least[new] = np.partition(dots[new], len(y) - some, axis=1)[:, len(y) - some]
            i, j = np.nonzero(dots >= least[:, None])
            value = dots[i, j]
            order = np.lexsort((j, -value, i))
            i, j, value = i[order], j[order], value[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            rows.append(i[kept] + at)
            cols.append(j[kept])
            exact.append(value[kept])
        none = np.zeros(0, np.int64)
        found = np.concatenate([none, *cols])
        return pa.table({"anchor": names[np.concatenate([none, *rows])], "point": points[found],
                         "first": members.column("first").take(pa.array(found)),
                         "exact": np.concatenate([none.astype(float), *exact])})

    return work


def _visits(anchors: DataFrame, cuts: tuple[np.ndarray, np.ndarray], low: np.ndarray,
            high: np.ndarray, length: np.ndarray, size: np.ndarray, k: int,
            again: bool) -> DataFrame:
    """(anchor, cell) to look at: first its own cell, with the closest ones where that holds less
    than k points; then (``bound`` being the k-th best of these) all others that can reach it."""
    step = max(1, TILE // len(size))

    def reach(x: np.ndarray) -> np.ndarray:
        far = np.zeros((len(x), len(size)))
        for c in range(x.shape[1]):
            line = x[:, c:c + 1]
            gap = np.maximum(np.maximum(low[:, c] - line, line - high[:, c]), 0.0)
            far += gap * gap
        return ((x * x).sum(axis=1)[:, None] + length - far) / 2

    def near(x: np.ndarray, most: np.ndarray | None) -> np.ndarray:
        """Which cells are looked at first."""
        home = _home(x, *cuts)
        first = np.zeros((len(x), len(size)), bool)
        first[np.arange(len(x)), home] = True
        few = np.flatnonzero(size[home] < k)
        if len(few):
            order = np.argsort(-(reach(x[few]) if most is None else most[few]), axis=1,
                               kind="stable")
            held = np.cumsum(size[order], axis=1)
            some = held - size[order] < k
            i, j = np.nonzero(some)
            first[few[i], order[i, j]] = True
        return first & (size > 0)

    def run(batches):
        for batch in batches:
            x = _matrix(batch)
            bounds = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            bounds = np.where(np.isnan(bounds), -np.inf, bounds)
            rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at in range(0, len(x), step):
                some = x[at:at + step]
                if again:
                    most = reach(some)
                    chosen = ((most + 1e-9 >= bounds[at:at + step, None]) & (size > 0)
                              & ~near(some, most))
                else:
                    chosen = near(some, None)
                i, j = np.nonzero(chosen)
                rows.append(i + at)
                cells.append(j)
            taken = batch.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(np.concatenate(cells).astype(np.int32))],
                names=[*batch.schema.names, "cell"])

    return anchors.select("anchor", *UNITS, "bound").mapInArrow(
        run, f"anchor long, {_KINDS}, bound double, cell int")


def _met(visits: DataFrame, members: DataFrame, cells: DataFrame, k: int,
         chunk: int, tasks: int) -> DataFrame:
    """(anchor, point, first, exact): per visit and chunk the k best."""
    asked = stage(visits, "visits")
    parts = asked.groupBy("cell").agg(
        F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("parts"))
    known = F.broadcast(cells.join(parts, "cell"))  # one row per cell
    left = asked.join(known, "cell").select(
        "anchor", *UNITS, "bound", "cell",
        F.pmod(F.xxhash64("anchor"), "parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = members.join(known, "cell").select(
        "point", "first", *UNITS, "cell",
        F.pmod(F.xxhash64("point"), "chunks").cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    key = ["cell", "part", "chunk"]
    # A fixed number: the rows are few with much work.
    left, right = (d.repartition(tasks, *key).groupBy(*key) for d in (left, right))
    return left.cogroup(right).applyInArrow(
        _best(k), "anchor long, point long, first string, exact double")


def _ranked(found: DataFrame, by: str, then: str, k: int) -> DataFrame:
    """The k best of each ``by``, ties by ``then``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("exact"), then))
    return found.withColumn("place", place).where(F.col("place") <= k)


def lookalikes_many(scaled: DataFrame, anchors: DataFrame, k: int = 8,
                    chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, place, customer_id, similarity): for each of ``anchors(customer_id)`` the k
    other customers closest by cosine, ties by id.

    Anchors that are no customers get no rows; repeated ones count once. Customers without an id or
    with a feature that is no number are nobody's neighbours. The driver gets the points that
    choose the cuts and one row per cell, both bounded by ``CELLS``.
    """
    usable = F.col("customer_id").isNotNull()
    for u in UNITS:
        usable &= F.col(u).isNotNull() & ~F.isnan(u)
    units = stage(scaled.select("customer_id", *[
        u.alias(name) for u, name in zip(unit_columns(), UNITS)]).where(usable), "units")
    wanted = stage(units.join(anchors.select("customer_id").distinct(), "customer_id"), "wanted")
    # Rows that an anchor's own id has: one, unless ids are repeated.
    own = wanted.groupBy("customer_id").count().agg(F.max("count")).first()[0]
    if own is None or k < 1:
        return units.select(F.col("customer_id").alias("anchor_id"), F.lit(1).alias("place"),
                            "customer_id", F.lit(0.0).alias("similarity")).limit(0)
    most = k + own                                     # the own rows are taken out at the end
    turn = F.row_number().over(Window.partitionBy(*UNITS).orderBy("customer_id"))
    points = stage(units.withColumn("turn", turn).where(F.col("turn") <= most).groupBy(*UNITS).agg(
        F.sort_array(F.collect_list("customer_id")).alias("ids")).select(
        F.monotonically_increasing_id().alias("point"), F.col("ids")[0].alias("first"), "ids",
        *UNITS), "points")
    n = points.count()
    count = 1 << (min(CELLS, max(1, n // LEAF)).bit_length() - 1)
    drawn = points.where(F.pmod(F.xxhash64("first"), F.lit(max(1, n // (DRAWN * count)))) == 0)
    cuts = _cuts(_matrix(drawn.select(*UNITS).toArrow()), count)
    members = stage(_celled(points, cuts), "members")
    square = sum((F.col(u) * F.col(u) for u in UNITS), F.lit(0.0))
    facts = members.groupBy("cell").agg(
        F.count("*").alias("size"), F.max(square).alias("length"),
        *[f(u).alias(f"{name}_{u}") for name, f in (("low", F.min), ("high", F.max))
          for u in UNITS]).toPandas()
    at, size, length = facts["cell"].to_numpy(), np.zeros(count, np.int64), np.zeros(count)
    low, high = np.zeros((count, len(UNITS))), np.zeros((count, len(UNITS)))
    size[at], length[at] = facts["size"], facts["length"]
    low[at], high[at] = facts[[f"low_{u}" for u in UNITS]], facts[[f"high_{u}" for u in UNITS]]
    cells = members.groupBy("cell").agg(
        F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
    asked = stage(wanted.groupBy(*UNITS).agg(F.lit(None).cast("double").alias("bound")).select(
        F.monotonically_increasing_id().alias("anchor"), *UNITS, "bound"), "asked")

    def met(some: DataFrame, again: bool) -> DataFrame:
        return _met(_visits(some, cuts, low, high, length, size, most, again), members, cells,
                    most, chunk, max(1, count // 4))

    first = stage(_ranked(met(asked, False), "anchor", "first", most), "near")
    bounds = first.where(F.col("place") == most).select("anchor", F.col("exact").alias("bound"))
    more = met(asked.drop("bound").join(bounds, "anchor", "left"), True)
    best = _ranked(first.drop("place").unionByName(more), "anchor", "first", most)
    named = _ranked(best.select("anchor", "point", "exact").join(
        points.select("point", F.explode("ids").alias("customer_id")), "point"),
        "anchor", "customer_id", most).select("anchor", "customer_id", "exact")
    # Anchors that coincide share their neighbours, each without itself.
    holders = wanted.withColumnRenamed("customer_id", "anchor_id").join(
        asked.drop("bound"), UNITS).select("anchor_id", "anchor")
    others = holders.join(named, "anchor").where(F.col("anchor_id") != F.col("customer_id"))
    return _ranked(others, "anchor_id", "customer_id", k).select(
        "anchor_id", "place", "customer_id", half_even(F.col("exact"), 3).alias("similarity"))
