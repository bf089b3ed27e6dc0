"""Near duplicates of vectors against all pairs, and the recall at the limit of similarity."""

import math

import numpy as np
import pytest

from tallyspark.llm import embedding_dedup
from tallyspark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    vectors = []
    for _, v in rows:
        x = np.array(v if v and None not in v else [np.nan], np.float32).astype(float)
        vectors.append(x / np.sqrt((x * x).sum()) if np.isfinite(x).all() and x.any() else None)
    n = len(rows)
    link = [[i != j and vectors[i] is not None and vectors[j] is not None
             and len(vectors[i]) == len(vectors[j]) and (vectors[i] * vectors[j]).sum() >= 0.9
             for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(n) if link[k][j]} - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], sum(link[i]), least, least is not None and rows[i][0] == least))
    return sorted(out, key=str)


def got(spark, rows, **options):
    frame = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "'x' as label", "'y' as node", "1 as bucket"), **options)
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_hadamard_and_keys():
    x = np.random.default_rng(1).standard_normal((5, 8))
    matrix = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)])
    assert np.allclose(embedding_dedup.hadamard(x), x @ matrix)
    hasher = embedding_dedup.plan(5, 3000)
    keys = hasher.keys(x[:, :5])
    assert keys.shape == (5, hasher.tables, 1 + hasher.probes)
    assert (keys == np.concatenate([hasher.keys(x[k:k + 1, :5]) for k in range(5)])).all()
    assert (hasher.keys(4 * x[:, :5])[:, :, 0] == keys[:, :, 0]).all()
    assert all(len(set(t[t >= 0])) == (t >= 0).sum() for v in keys for t in v)


@pytest.mark.parametrize("vectors", [500, 50_000, 10**7])
def test_recall_at_the_limit(vectors):
    """Pairs whose cosine is just above the limit share a looked-up bucket in some table."""
    rng = np.random.default_rng(vectors)
    x, z = rng.standard_normal((2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    hasher = embedding_dedup.plan(64, vectors)
    here, there = embedding_dedup.found(
        hasher.keys(x), hasher.keys(0.9001 * x + math.sqrt(1 - 0.9001 ** 2) * z))
    assert (here | there).any(axis=1).mean() > 0.97


def odd_vectors():
    rng = np.random.default_rng(3)
    one, two = rng.standard_normal((2, 16)).astype(np.float32)
    near = [(one + 0.08 * rng.standard_normal(16)).tolist() for _ in range(40)]
    rows = [(100 + k, v) for k, v in enumerate(near)]
    rows += [(10 + k, two.tolist()) for k in range(12)] + [(9, (2 * two).tolist())]
    rows += [(200 + k, v.tolist()) for k, v in enumerate(rng.standard_normal((30, 16)))]
    rows += [(1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] * 16),
             (5, [float("inf"), *[1.0] * 15]), (6, [None, *[1.0] * 15]), (7, [1.0] * 3),
             (8, [1.0] * 3), (None, [1.0] * 3), (None, None), (None, [-1.0, 1.0, 0.0]),
             (300, [1e-30] * 16), (301, [3e38] * 16), (302, [-0.0, *[1.0] * 15]),
             (303, [0.0, *[1.0] * 15]), (7, [0.0, 0.0, 5.0]), (7, [0.0, 0.0, 5.0])]
    return rows


@pytest.mark.parametrize("tile", [1024, 8])
def test_all_pairs(spark, tile):
    """Copies, near copies, unusable vectors, repeated and missing ids; a bucket in one tile
    and one in many."""
    rows = odd_vectors()
    assert got(spark, rows, tile=tile, recall=0.9999) == plain(rows)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, [])]) == plain([(1, None), (2, [])])


def test_query(spark, folder):
    frame = QUERIES["op13_cross_polytope"](spark, folder)
    assert frame.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"),
                            ("component_id", "bigint"), ("kept", "boolean")]
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    assert sorted((tuple(r) for r in frame.collect()), key=str) == plain(
        [tuple(r) for r in rows.collect()])
