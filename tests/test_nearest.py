"""The k nearest of many anchors against all pairs, in cells and chunks of any size."""

import random

import numpy as np
import pytest

from tallyspark.operators import nearest
from tallyspark.operators.clusters import SCALED


def plain(rows, anchors, k):
    units = {c: np.array(v) / (np.sqrt(sum(x * x for x in v)) + 1e-9) for c, *v in rows}
    out = []
    for a in sorted(set(anchors) & set(units)):
        near = sorted((-sum(x * y for x, y in zip(units[a], u)), c) for c, u in units.items() if c != a)
        out += [(a, p, c, round(-s, 3)) for p, (s, c) in enumerate(near[:k], 1)]
    return out


def cluster(rng, n, spread):
    middle = [rng.gauss(0, 1) for _ in SCALED]
    return [[m + rng.gauss(0, spread) for m in middle] for _ in range(n)]


@pytest.mark.parametrize("k,chunk", [(4, 10_000), (9, 16)])
def test_against_all_pairs(spark, k, chunk):
    """Clusters, a third of all customers in one point, one without direction, absent anchors."""
    rng = random.Random(k)
    points = [p for n, s in ((60, 0.05), (60, 0.3), (40, 2.0)) for p in cluster(rng, n, s)]
    points += [points[3]] * 80 + [[0.0] * len(SCALED)]
    rows = [(f"c{i}", *p) for i, p in enumerate(points)]
    anchors = [f"c{i}" for i in range(0, len(rows), 7)] + ["c7", "nobody"]
    scaled = spark.createDataFrame(rows, ["customer_id", *SCALED]).repartition(3)
    got = nearest.lookalikes_many(scaled, spark.createDataFrame(
        [(a,) for a in anchors], "customer_id string"), k, chunk)
    found = sorted(((r.anchor_id, r.place, r.customer_id, r.similarity) for r in got.collect()))
    want = sorted(plain(rows, anchors, k))
    assert [x[:3] for x in found] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in found], [x[3] for x in want], atol=1.1e-3)


def test_few_customers_and_no_product(spark):
    rows = [("a", *[1.0] * 6), ("b", *[1.0] * 6), ("c", *[-1.0] * 6)]
    scaled = spark.createDataFrame(rows, ["customer_id", *SCALED])
    frame = nearest.lookalikes_many(scaled, scaled.select("customer_id"), 5)
    assert sorted((r.anchor_id, r.place, r.customer_id) for r in frame.collect()) == [
        ("a", 1, "b"), ("a", 2, "c"), ("b", 1, "a"), ("b", 2, "c"), ("c", 1, "a"), ("c", 2, "b")]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert nearest.lookalikes_many(scaled.where("false"), scaled).collect() == []
    assert nearest.lookalikes_many(scaled, scaled.where("false")).collect() == []


def met(monkeypatch, run):
    """Pairs of rows that meet in the tasks, and the visits, of a run."""
    kept, stage = {}, nearest.stage
    monkeypatch.setattr(nearest, "stage", lambda df, label: kept.setdefault(label, []).append(
        stage(df, label)) or kept[label][-1])
    rows = run().collect()
    sizes = {r["cell"]: r["count"] for r in kept["members"][0].groupBy("cell").count().collect()}
    cells = [r["cell"] for v in kept["visits"] for r in v.select("cell").collect()]
    return rows, sum(sizes[c] for c in cells), len(cells)


def test_customers_that_coincide_are_compared_once(spark, monkeypatch):
    rng = random.Random(1)
    points = cluster(rng, 20, 1.0)
    rows = [(f"c{i}", *points[i % 20]) for i in range(1000)]
    scaled = spark.createDataFrame(rows, ["customer_id", *SCALED])
    got, pairs, visits = met(monkeypatch, lambda: nearest.lookalikes_many(scaled, scaled, 60))
    assert visits <= 40 and pairs <= 2 * 20 * 20
    assert sorted((r.anchor_id, r.place, r.customer_id) for r in got) == [
        x[:3] for x in plain(rows, [r[0] for r in rows], 60)]


def test_boxes_leave_out_most_of_different_customers(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"c{i}", *[rng.gauss(0, 1) for _ in SCALED]) for i in range(8000)]
    scaled = spark.createDataFrame(rows, ["customer_id", *SCALED])
    anchors = [f"c{i}" for i in range(0, 8000, 80)]
    monkeypatch.setattr(nearest, "LEAF", 64, raising=False)
    got, pairs, _ = met(monkeypatch, lambda: nearest.lookalikes_many(
        scaled, spark.createDataFrame([(a,) for a in anchors], "customer_id string")))
    assert pairs < 0.25 * len(anchors) * len(rows)
    assert sorted((r.anchor_id, r.place, r.customer_id) for r in got) == [
        x[:3] for x in plain(rows, anchors, 8)]


def test_repeated_and_missing_ids(spark):
    """An id with several rows keeps the best of them all, none of its own rows among them."""
    rng = random.Random(3)
    rows = [(f"c{i % 30}", *p) for i, p in enumerate(cluster(rng, 50, 0.5))] * 2
    rows += [(None, *rows[0][1:]), ("nan", *[float("nan")] * 6)]
    scaled = spark.createDataFrame(rows, ["customer_id", *SCALED])
    got = nearest.lookalikes_many(scaled, scaled.where("customer_id in ('c1', 'c25', 'nan')"), 7)
    want = []
    for a in ("c1", "c25"):
        units = [(c, np.array(v) / (np.sqrt(sum(x * x for x in v)) + 1e-9)) for c, *v in rows[:-2]]
        near = sorted((-sum(x * y for x, y in zip(u, w)), c)
                      for b, u in units if b == a for c, w in units if c != a)
        want += [(a, p, c) for p, (_, c) in enumerate(near[:7], 1)]
    assert sorted((r.anchor_id, r.place, r.customer_id) for r in got.collect()) == want
