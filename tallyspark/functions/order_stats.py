"""Exact order statistics of large columns.

A global sort, an unpartitioned window or ``percentile`` would bring a whole column into
one task. Here each wanted rank is enclosed step by step: a mergeable sketch of the values still
in question gives two of them close to the rank, and a counting pass tells on which side of them,
between them, or at which of them the rank lies. Between two such values lie about ``2 * SLACK``
of the rows (one in five thousand), their ties left out, so few steps are enough at any size and
for any distribution. Once at most ``RANKED`` rows are left they are sorted, so the last step is
the same small task whatever the table. The result is exact; a poor sketch only costs a step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 20_000
SLACK = 2.0 / ACCURACY
#: Rows around a rank that are sorted in one task.
RANKED = 100_000


@dataclass(frozen=True)
class Wanted:
    """The ``rank(n)``-th smallest (1-based) of ``column``, found near ``fraction``."""

    column: str
    fraction: float
    rank: Callable[[int], int]


@dataclass(frozen=True)
class Found:
    """The value at the rank, how many rows lie below it and how many equal it."""

    value: float | None
    below: int
    equal: int
    n: int


@dataclass(frozen=True)
class _Span:
    """Values strictly between two others: how many rows lie at or below its lower bound, and
    how many inside; ``rank`` is the wanted one among all rows."""

    rank: int
    below: int
    inside: int
    low: float | None = None
    high: float | None = None
    stuck: bool = False

    def edges(self, column: str) -> Column:
        """Two values close to the rank; where a sketch was of no use, the least and the mean."""
        value = F.when(self.holds(F.col(column)), F.col(column))
        if self.stuck:
            return F.array(F.min(value), F.greatest(F.min(value), F.avg(value)))
        near = (self.rank - self.below) / self.inside
        return F.percentile_approx(
            value, [min(1.0, max(0.0, near + d)) for d in (-SLACK, SLACK)], ACCURACY)

    def holds(self, value: Column) -> Column:
        test = value.isNotNull()
        if self.low is not None:
            test = test & (value > F.lit(self.low))
        return test if self.high is None else test & (value < F.lit(self.high))


def find_ranks(df: DataFrame, wanted: list[Wanted], ranked: int = RANKED) -> list[Found]:
    """Locate every wanted rank among the non-null values; columns must be numeric."""
    columns = list(dict.fromkeys(w.column for w in wanted))
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = values.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    size = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    found = {w: Found(None, 0, 0, 0) for w in wanted if not size[w.column]}
    spans = {w: _Span(w.rank(size[w.column]), 0, size[w.column])
             for w in wanted if size[w.column]}
    while wide := {w: s for w, s in spans.items() if s.inside > ranked}:
        for w, (span, hit) in _narrowed(values, wide, size).items():
            spans[w] = span
            if hit:
                found[w] = hit
                del spans[w]
    if spans:
        found.update(_rank_inside(values, spans, size))
    return [found[w] for w in wanted]


def _narrowed(values: DataFrame, spans: dict, size: dict) -> dict:
    """Each span cut at two values near its rank, or the rank itself where it is one of them."""
    order = list(spans)
    edges = values.agg(*[s.edges(w.column).alias(f"e{t}")
                         for t, (w, s) in enumerate(spans.items())]).first()
    counts = values.agg(*[
        F.count_if(s.holds(F.col(w.column)) & test).alias(f"{name}{side}_{t}")
        for t, (w, s) in enumerate(spans.items()) for side in (0, 1)
        for name, test in (("less", F.col(w.column) < F.lit(edges[t][side])),
                           ("same", F.col(w.column) == F.lit(edges[t][side])))]).first()
    out = {}
    for t, w in enumerate(order):
        s, (low, high) = spans[w], edges[t]
        less, same = ([counts[f"{name}{side}_{t}"] for side in (0, 1)]
                      for name in ("less", "same"))
        k, hit = s.rank - s.below, None
        # Values of a poor sketch may lie outside the span; it never grows.
        above = [x if s.low is None else max(x, s.low) for x in (low, high)]
        upto = [x if s.high is None else min(x, s.high) for x in (low, high)]
        if k <= less[0]:
            s = replace(s, high=upto[0], inside=less[0])
        elif k <= less[0] + same[0]:
            hit = Found(low, s.below + less[0], same[0], size[w.column])
        elif k <= less[1]:
            s = replace(s, low=above[0], high=upto[1], below=s.below + less[0] + same[0],
                        inside=less[1] - less[0] - same[0])
        elif k <= less[1] + same[1]:
            hit = Found(high, s.below + less[1], same[1], size[w.column])
        else:
            s = replace(s, low=above[1], below=s.below + less[1] + same[1],
                        inside=s.inside - less[1] - same[1])
        out[w] = replace(s, stuck=s.inside == spans[w].inside), hit
    return out


def _rank_inside(values: DataFrame, spans: dict, size: dict) -> dict:
    """Ranks among the distinct values of their spans, which are bounded in rows."""
    order = list(spans)
    tags = F.array(*[
        F.when(spans[w].holds(F.col(w.column)), F.struct(
            F.lit(t).alias("tag"), F.col(w.column).alias("v"))) for t, w in enumerate(order)])
    inside = (values.select(F.explode(F.array_compact(tags)).alias("x"))
              .groupBy(F.col("x.tag").alias("tag"), F.col("x.v").alias("v"))
              .agg(F.count(F.lit(1)).alias("equal")))
    upto = F.sum("equal").over(Window.partitionBy("tag").orderBy("v"))
    goal = F.element_at(F.array(*[F.lit(spans[w].rank - spans[w].below) for w in order]),
                        F.col("tag") + 1)
    hits = (inside.withColumn("upto", upto)
            .where((F.col("upto") >= goal) & (F.col("upto") - F.col("equal") < goal))
            .collect())
    return {order[h.tag]: Found(h.v, spans[order[h.tag]].below + h.upto - h.equal, h.equal,
                                size[order[h.tag].column]) for h in hits}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact median per column (mean of the two middle values), null when empty."""
    wanted = [w for c in columns for w in (
        Wanted(c, 0.5, lambda n: (n + 1) // 2), Wanted(c, 0.5, lambda n: n // 2 + 1))]
    found = find_ranks(df, wanted)
    return {
        c: None if lo.value is None else (lo.value + hi.value) / 2.0
        for c, lo, hi in zip(columns, found[0::2], found[1::2])
    }


def median(df: DataFrame, column: str) -> float | None:
    return medians(df, [column])[column]
