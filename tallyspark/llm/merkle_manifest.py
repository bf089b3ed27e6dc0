"""Merkle manifest of a dataset, and proofs by descent of a content-addressed tree.

Every row is a leaf. The leaves of a source, in the order of their ids, make one tree whose
nodes hash up to three children; the roots of the sources, in the order of their names, make
the tree of the dataset in the same way.

*Build.* Rows are sorted by range over (source, id), so that a source of any size is many
partitions, and a row's place follows from a count per partition. Blocks of 3^6 neighbours
become six levels of nodes at once; their tops are the nodes of the next layer. What is stored
are records of a digest and its children, bundled by block and found by the digest of the
bundle's top. A tree of 10^9 leaves has four layers.

*Prove.* Requests descend from the root. The digits of a leaf's place in base three say which
child to take; the children left aside are collected as a segment of the path, and the segments
are reversed at the leaf. Requests below one node share its descent: each layer joins one row
per requested block with its bundle by digest, so no node is joined once per leaf below it.

Defined results: null columns hash as ``-``; rows without source make the first tree, rows
without id come first in theirs. Rows with one (source, id) are ordered by leaf, so equal rows
have equal proofs up to their place. Empty and very long texts are ordinary values (a text is
hashed in the JVM once and never shuffled). An empty table gives no rows. Other columns are not
read, whatever their names. Were all rows of a block equal to those of others, their bundles
would be one record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage

from .common import column, map_batches

ARITY, HEIGHT = 3, 6
FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long",
          "text": "string"}
#: Rows of a table that is known to be short, up to which it is sent to every task.
SHORT = 100_000


def row_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each with its length in front, as 32 bytes."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"),
                                 v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered) per row: ``tampered`` is the leaf of the row's text without
    line ends where its id calls for that, else null."""
    cell = {name: column(docs, name, kind) for name, kind in FIELDS.items()}
    bare = F.replace(cell["text"], F.lit("\n"), F.lit(""))
    picked = F.crc32(cell["doc_id"].cast("string").cast("binary")) % 2 == 0
    other = row_digest([bare if name == "text" else c for name, c in cell.items()])
    return docs.select(
        # The byte order of this name is that of the sources, with null first.
        F.coalesce(F.concat(F.lit("+"), cell["source"]), F.lit("")).alias("tree"),
        cell["doc_id"].alias("doc_id"), row_digest(list(cell.values())).alias("leaf"),
        F.when(picked, other).alias("tampered"))


def _short(df: DataFrame) -> DataFrame:
    """For a join: sent to every task if it has few rows, else left to Spark."""
    return F.broadcast(df) if df.limit(SHORT + 1).count() <= SHORT else df


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(tree, ...)`` with ``place`` (from 0, by ``order`` within the tree) and the tree's
    size ``n``. Sorted by range over (tree, order); no tree meets in one task."""
    by = ["tree", *order]
    laid = stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
        "row", F.monotonically_increasing_id()).withColumn(
        "part", F.shiftright("row", 33)), "placed")
    # One row for each partition, and one more for each tree that begins inside one.
    runs = stage(laid.groupBy("tree", "part").agg(
        F.min("row").alias("first"), F.count("*").alias("some")), "runs")
    total = runs.groupBy(F.col("tree").alias("name")).agg(F.sum("some").alias("n"))
    ahead = F.sum("some").over(_before()) - F.col("some")
    runs = runs.withColumn("ahead", ahead).join(total, F.col("tree") == F.col("name")).select(
        F.col("tree").alias("t"), F.col("part").alias("p"), "first", "ahead", "n")
    return laid.join(_short(runs), (F.col("tree") == F.col("t")) & (F.col("part") == F.col("p"))
                     ).withColumn("place", F.col("row") - F.col("first") + F.col("ahead")).drop(
        "row", "part", "t", "p", "first", "ahead")


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)


def node_digest(children: list[bytes]) -> bytes:
    """SHA-256 of the children's digests as hexadecimal text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def _bundler(height: int):
    wide = ARITY ** height

    def work(tree, block, n, nodes):
        tops, heights, records = [], [], []
        for size, some in zip(n, nodes, strict=True):
            level = [x["digest"] for x in sorted(some, key=lambda x: x["place"])]
            made, climbed = [], 0
            # Six levels below other bundles; the last bundle of a tree ends at its root.
            while (climbed < height) if size > wide else len(level) > 1:
                runs = [level[k:k + ARITY] for k in range(0, len(level), ARITY)]
                level = [node_digest(run) for run in runs]
                made += [{"digest": d, "children": b"".join(run)}
                         for d, run in zip(level, runs, strict=True)]
                climbed += 1
            tops.append(level[0])
            heights.append(climbed)
            records.append(made)
        yield tree, block, n, tops, heights, records

    return work


BUNDLE = ("tree string, block long, n long, top binary, height int, "
          "records array<struct<digest: binary, children: binary>>")


@dataclass
class Forest:
    """Trees as layers of bundles; ``roots(tree, top, n)`` has the root of each."""

    layers: list[DataFrame]
    roots: DataFrame
    height: int

    @property
    def wide(self) -> int:
        return ARITY ** self.height


def grow(nodes: DataFrame, height: int = HEIGHT) -> Forest:
    """All layers above ``nodes(tree, place, n, digest)``."""
    wide = ARITY ** height
    layers, roots = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        blocks = nodes.groupBy("tree", F.expr(f"place div {wide}").alias("block"), "n").agg(
            F.collect_list(F.struct("place", "digest")).alias("nodes"))
        bundles = stage(map_batches(blocks, _bundler(height), BUNDLE), "bundles")
        layers.append(bundles)
        roots.append(bundles.where(F.col("n") <= wide).select("tree", "top", F.col("n")))
        if most <= wide:
            break
        most = -(-most // wide)
        nodes = bundles.where(F.col("n") > wide).select(
            "tree", F.col("block").alias("place"),
            F.ceil(F.col("n") / F.lit(wide)).cast("long").alias("n"),
            F.col("top").alias("digest"))
    found = roots[0].withColumn("layer", F.lit(0))
    for k, more in enumerate(roots[1:], 1):
        found = found.unionByName(more.withColumn("layer", F.lit(k)))
    return Forest(layers, found, height)


def _descent(height: int, noted: bool):
    """One bundle, its requested places, and the path so far: the path to each of them.

    A segment of a path is the number of the child taken, the number of children, and the
    digests of the children left aside.
    """

    def work(tree, block, top, path, root, tall, records, wanted):
        out: tuple[list, ...] = ([], [], [], [], [], [])[:6 if noted else 5]
        for name, at, digest, above, roots, levels, some, asked in zip(
                tree, block, top, path, root, tall, records, wanted, strict=True):
            children = {r["digest"]: r["children"] for r in some}
            places = [x["place"] for x in asked]
            reached = {0: (digest, above)}
            for level in range(levels - 1, -1, -1):
                step, below = ARITY ** level, {}
                for prefix in {p // step for p in places}:
                    node, trail = reached[prefix // ARITY]
                    run, digit = children[node], prefix % ARITY
                    low, high = 32 * digit, 32 * digit + 32
                    below[prefix] = run[low:high], trail + bytes(
                        [digit, len(run) // 32]) + run[:low] + run[high:]
                reached = below
            for x in asked:
                out[0].append(name)
                out[1].append(at * ARITY ** height + x["place"])
                out[2].append(reached[x["place"]][0])
                out[3].append(reached[x["place"]][1])
                out[4].append(roots)
                if noted:
                    out[5].append(x["note"])
        yield out

    return work


REACHED = "tree string, place long, digest binary, path binary, root binary"


def descend(forest: Forest, starts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tree, place, digest, path, root, note) of each of ``wanted(tree, place, note)``.

    ``starts(tree, path, root)`` has what lies above each tree. A node is found by its digest,
    from the tree's root down; requests below one node go down together.
    """
    wide, reached = forest.wide, None
    begin = forest.roots.join(starts, "tree").select(
        "tree", F.lit(0).cast("long").alias("block"), F.col("top").alias("digest"), "path",
        "root", "layer")
    for k in range(len(forest.layers) - 1, -1, -1):
        at = begin.where(F.col("layer") == k).drop("layer")
        at = at if reached is None else at.unionByName(
            reached.withColumnRenamed("place", "block"))
        block = F.expr(f"place div {wide ** (k + 1)}L").alias("block")
        here = F.expr(f"place div {wide ** k}L % {wide}").cast("int").alias("place")
        asked = wanted.groupBy("tree", block).agg(
            F.collect_set(F.struct(here)).alias("wanted") if k
            else F.collect_list(F.struct(here, "note")).alias("wanted"))
        # Bundles with one top are one record.
        store = forest.layers[k].groupBy("top").agg(F.first("height").alias("height"),
                                                    F.first("records").alias("records"))
        rows = at.join(asked, ["tree", "block"]).join(store, F.col("digest") == F.col("top"))
        note = "" if k else f", note {wanted.schema['note'].dataType.simpleString()}"
        reached = map_batches(rows.select(
            "tree", "block", "top", "path", "root", "height", "records", "wanted"),
            _descent(forest.height, not k), REACHED + note)
        if k:
            reached = stage(reached, "reached")
    return reached


@dataclass
class Manifest:
    """The leaves in their places, the trees of the sources, and the tree above them."""

    leaves: DataFrame
    sources: Forest
    above: Forest
    names: DataFrame

    def prove(self, requests: DataFrame) -> DataFrame:
        """(tree, place, leaf, path, subroot, root, note) of ``requests(tree, place, note)``."""
        top = self.above.roots.select(F.lit("").alias("tree"), F.lit(b"").alias("path"),
                                      F.col("top").alias("root"))
        asked = self.names.join(requests.groupBy(F.col("tree").alias("name")).agg(
            F.count("*").alias("some")), "name")
        to_sources = descend(self.above, top, asked.select(
            "tree", "place", F.col("name").alias("note")))
        # On the way down the root of the source rides in front of the dataset's.
        starts = stage(to_sources.select(F.col("note").alias("tree"), "path", F.concat(
            "digest", "root").alias("root")), "starts")
        return descend(self.sources, starts, requests).select(
            "tree", "place", F.col("digest").alias("leaf"), "path",
            F.substring("root", 1, 32).alias("subroot"),
            F.substring("root", 33, 32).alias("root"), "note")


def build(docs: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of all rows of ``docs``, written to the staging folder."""
    rows = stage(placed(leaves(docs), ["doc_id", "leaf", "tampered"]), "leaves")
    sources = grow(rows.select("tree", "place", "n", F.col("leaf").alias("digest")), height)
    names = stage(placed(sources.roots.select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest")),
        ["name"]), "names")
    return Manifest(rows, sources, grow(names.select("tree", "place", "n", "digest"), height),
                    names)


def _segments(path: bytes) -> Iterator[tuple[int, bytes]]:
    """Number of the child taken and the digests left aside, from the root down."""
    at = 0
    while at < len(path):
        size = 32 * (path[at + 1] - 1)
        yield path[at], path[at + 2:at + 2 + size]
        at += 2 + size


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    for digit, others in reversed(list(_segments(path))):
        leaf = hashlib.sha256((others[:32 * digit] + leaf + others[32 * digit:]).hex().encode()
                              ).digest()
    return leaf


def siblings(path: bytes) -> str:
    """The siblings from the leaf up to the root, as hexadecimal text."""
    return b"".join(others for _, others in reversed(list(_segments(path)))).hex()


def _verdicts(doc_id, leaf, tampered, path, subroot, root):
    folded = [fold(t or x, p) for t, x, p in zip(tampered, leaf, path, strict=True)]
    yield (doc_id, [x.hex() for x in leaf], [x.hex() for x in subroot], [x.hex() for x in root],
           [hashlib.sha256(siblings(p).encode()).hexdigest() for p in path],
           [x.hex() for x in folded], [a == b for a, b in zip(folded, root, strict=True)])


VERDICT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
           "folded_root string, verified boolean")


def audit(manifest: Manifest) -> DataFrame:
    """Every row proven by descent, and its leaf, tampered or not, folded up to the root."""
    proofs = manifest.prove(manifest.leaves.select(
        "tree", "place", F.struct("doc_id", "tampered").alias("note")))
    return map_batches(proofs.select("note.doc_id", "leaf", "note.tampered", "path", "subroot",
                                     "root"), _verdicts, VERDICT)
