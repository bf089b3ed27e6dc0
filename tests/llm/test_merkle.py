"""The manifest against a plain Merkle tree in Python, proofs folded by themselves."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import merkle_manifest


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(level):
    """The root, and for each leaf the (left, right) siblings from below."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3:i // 3 * 3 + 3]
            paths[k].append((run[:i % 3], run[i % 3 + 1:]))
        at = [i // 3 for i in at]
        level = [digest(level[j:j + 3]) for j in range(0, len(level), 3)]
    return level[0], paths


def plain_audit(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    trees = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        some = sorted(((r[0] is not None, r[0] or 0), leaf_of(r), r) for r in groups[source])
        trees.append((some, *plain_tree([leaf for _, leaf, _ in some])))
    root, above = plain_tree([sub for _, sub, _ in trees]) if trees else (None, [])
    out = []
    for (some, sub, paths), rest in zip(trees, above):
        for (_, leaf, row), path in zip(some, paths):
            path = path + rest
            folded = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4]:
                folded = leaf_of((*row[:4], row[4].replace("\n", "")))
            for low, high in path:
                folded = digest([*low, folded, *high])
            proof = digest(x for low, high in path for x in low + high)
            out.append((row[0], leaf, sub, root, proof, folded, folded == root))
    return sorted(out, key=str)


def given(docs):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    return sorted((tuple(r) for r in docs.select(*names).collect()), key=str)


def audited(docs, height):
    rows = merkle_manifest.audit(merkle_manifest.build(docs, height)).collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("height", [1, 6])
def test_odd_rows(odd, height):
    rows = given(odd)
    got = audited(odd, height)
    assert [g for g in got if g[0] != 6] == [w for w in plain_audit(
        [tuple(r) for r in rows]) if w[0] != 6]
    # The two equal rows differ in their places alone.
    assert len([g for g in got if g[0] == 6]) == 2
    assert audited(odd.where("false"), height) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28])
def test_sizes_of_trees(spark, n):
    """One large source beside single rows: lone leaves, runs of one and two, several layers."""
    docs = spark.range(n + 3).select(
        (F.col("id") * 7 - 5).alias("doc_id"), F.concat(F.lit("a\nb"), "id").alias("text"),
        F.lit("en").alias("lang"), F.when(F.col("id") < n, "big").when(
            F.col("id") == n, None).otherwise(F.concat(F.lit("é"), "id")).alias("source"),
        F.lit(None).cast("long").alias("n_chars"))
    assert audited(docs, 1) == plain_audit(given(docs))


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = audited(docs, 2)
    assert got == plain_audit(given(docs))
    changed = {r[0] for r in got if not r[-1]}
    assert changed and len(changed) < len(got)
    for row in given(docs):
        even = zlib.crc32(str(row[0]).encode()) % 2 == 0
        assert (row[0] in changed) == (even and "\n" in (row[4] or ""))


def test_proofs_of_some_leaves(spark, folder):
    """A request reaches its leaf whichever others descend with it, and a false leaf is seen."""
    manifest = merkle_manifest.build(spark.read.parquet(f"{folder}/documents.parquet"), 1)
    wanted = manifest.leaves.where("doc_id % 9 = 4").select(
        "tree", "place", F.struct("doc_id", F.col("leaf").alias("kept")).alias("note"))
    rows = manifest.prove(wanted).collect()
    assert len(rows) == wanted.count() > 10
    for row in rows:
        path = bytes(row["path"])
        assert row["leaf"] == row["note"]["kept"]
        assert merkle_manifest.fold(bytes(row["leaf"]), path) == row["root"]
        assert merkle_manifest.fold(b"\0" * 32, path) != row["root"]
