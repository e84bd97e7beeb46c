"""Merkle manifest of a dataset: few stored levels, the others made again for proofs.

Every document is a leaf; the leaves of a source form a tree in the order of
their ids, and the roots of all sources form one more tree in the order of the
sources.  FAN consecutive nodes become their hash.  Of a tree only every
STRIDE-th level is written: an aligned subtree of FAN**STRIDE stored nodes is
raised in one task, which hands on its top and drops what lies between.

A proof is extracted from the top down.  Each subtree's task gets the stored
nodes below it and the proof of its top, makes the missing levels again, emits
for every stored node its siblings up to the root, and drops the levels.  No
task holds more than one subtree, however large a source is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.kernels import release
from emberline.sources.staging import stage

FAN = 16
STRIDE = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 32  # bytes of a digest


def node_hash(digests: bytes) -> bytes:
    """Hash of joined digests, which count as lowercase hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 (binary) of the fields: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


# ---- inside a task ----------------------------------------------------------------


def raise_level(digests: bytes) -> bytes:
    """The level above: the hash of every FAN nodes; the last run may be shorter."""
    run = FAN * WIDTH
    return b"".join(node_hash(digests[i : i + run]) for i in range(0, len(digests), run))


def steps_up(n: int, stride: int) -> int:
    """Levels from ``n`` nodes to the next stored one: fewer than ``stride`` if one node remains before."""
    steps = 0
    while n > 1 and steps < stride:
        n, steps = -(-n // FAN), steps + 1
    return steps


def subtree_levels(digests: bytes, n: int, stride: int) -> list[bytes]:
    """Levels of an aligned subtree: its stored nodes, those between, its top."""
    levels = [digests]
    for _ in range(steps_up(n, stride)):
        levels.append(raise_level(levels[-1]))
    return levels


def fold(leaf: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that a leaf and its proof lead to.

    ``shape`` holds two bytes a level, the node's place in its run and the
    run's size; ``siblings`` the run's other digests, level by level.
    """
    at = 0
    for place, size in zip(shape[::2], shape[1::2]):
        mid, end = at + place * WIDTH, at + (size - 1) * WIDTH
        leaf = node_hash(siblings[at:mid] + leaf + siblings[mid:end])
        at = end
    return leaf


def subtree_proofs(levels: list[bytes], siblings: bytes, shape: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(siblings, shape) of every stored node of a subtree, given the proof of its top."""
    for k in range(len(levels[0]) // WIDTH):
        parts, form, at = [], bytearray(), k
        for level in levels[:-1]:
            first, place = at - at % FAN, at % FAN
            run = level[first * WIDTH : (first + FAN) * WIDTH]
            parts += [run[: place * WIDTH], run[(place + 1) * WIDTH :]]
            form += bytes((place, len(run) // WIDTH))
            at //= FAN
        yield b"".join([*parts, siblings]), bytes(form) + shape


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one (tree, block) each, from rows sorted by these; at most one group is held."""
    held: list[pa.RecordBatch] = []

    def keys(batch):
        return batch.column("tree").fill_null("").to_pylist(), batch.column("tree").is_null().to_pylist(), batch.column("block").to_pylist()

    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = list(zip(*keys(batch)))
        cuts = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]]
        if held and rows[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        lo = 0
        for hi in cuts:
            yield pa.Table.from_batches([*held, batch.slice(lo, hi - lo)])
            held, lo = [], hi
        held.append(batch.slice(lo))
        last = rows[-1]
    if held:
        yield pa.Table.from_batches(held)


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _raise(stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches):
            tree, block, n = (group.column(c)[0].as_py() for c in ("tree", "block", "n"))
            top = subtree_levels(_joined(group.column("digest")), n, stride)[-1]
            out.append((tree, block, -(-n // FAN**stride), top))
            if len(out) == 4096:
                yield _nodes(out)
                out = []
        if out:
            yield _nodes(out)

    return run


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["tree", "pos", "n", "digest"])


Emit = Callable[[pa.Table, list[bytes], list[bytes]], pa.RecordBatch]


def _extract(stride: int, emit: Emit):
    """Proofs of the stored nodes of each subtree; its first row (no digest) brings the proof of its top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Table, list[bytes], list[bytes]]] = []
        rows = 0
        for group in _groups(batches):
            head, nodes = group.slice(0, 1), group.slice(1)
            if head.column("digest")[0].as_py() is not None:
                raise ValueError("a subtree without the proof of its top")
            if nodes.num_rows == 0:
                continue
            levels = subtree_levels(_joined(nodes.column("digest")), nodes.column("n")[0].as_py(), stride)
            proofs = list(subtree_proofs(levels, head.column("siblings")[0].as_py(), head.column("shape")[0].as_py()))
            held.append((nodes, [p[0] for p in proofs], [p[1] for p in proofs]))
            rows += nodes.num_rows
            if rows >= 1024:
                yield from _emitted(held, emit)
                held, rows = [], 0
        yield from _emitted(held, emit)
        release()

    return run


def _emitted(held: list, emit: Emit) -> Iterator[pa.RecordBatch]:
    if held:
        nodes = pa.concat_tables([h[0] for h in held])
        siblings, shapes = ([x for h in held for x in h[k]] for k in (1, 2))
        for lo in range(0, nodes.num_rows, 1024):
            yield emit(nodes.slice(lo, 1024), siblings[lo : lo + 1024], shapes[lo : lo + 1024])


# ---- the manifest -----------------------------------------------------------------


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (place in the tree, from 0) and ``n`` (nodes of the tree).

    ``order`` starts with ``tree``.  Rows are sorted into ranges; only the
    counts of each (range, tree) are summed, so a large tree is spread over
    many tasks.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    line = stage(ranged.withColumn("line", F.monotonically_increasing_id()), f"{name}-lines")
    line = line.withColumn("part", F.shiftright("line", 33))
    sizes = line.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("line").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(
        F.col("tree").alias("t"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("c").over(tree).alias("n")
    )
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p"))
    return line.join(sizes, same).select(*rows.columns, (F.col("line") + F.col("shift")).alias("pos"), "n")


def _blocks(nodes: DataFrame, stride: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(FAN**stride)).cast("long"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions(F.col("tree").asc_nulls_first(), "block", F.col("pos").asc_nulls_first())


@dataclass
class Forest:
    """Stored levels of trees: ``levels[k]`` holds tree, pos, n, digest of level k * stride."""

    levels: list[DataFrame]
    stride: int

    def roots(self) -> DataFrame:
        """tree, level (number of the stored level), digest: one row a tree."""
        found = None
        for k, nodes in enumerate(self.levels):
            here = nodes.filter("n = 1").select("tree", F.lit(k).alias("level"), "digest")
            found = here if found is None else found.unionByName(here)
        return found


def build(leaves: DataFrame, stride: int = STRIDE, name: str = "merkle") -> Forest:
    """Trees over placed leaves (tree, pos, n, digest and other columns); every stride-th level is written."""
    levels = [leaves]
    while True:
        below = levels[-1].filter("n > 1").select("tree", "pos", "n", "digest")
        if below.isEmpty():
            return Forest(levels, stride)
        up = _dealt(_blocks(below, stride)).mapInArrow(_raise(stride), "tree string, pos long, n long, digest binary")
        levels.append(stage(up, f"{name}-level{len(levels) * stride}"))


def proofs(forest: Forest, tops: DataFrame, emit: Emit, schema: str, payload: list[str]) -> DataFrame:
    """``emit`` of every leaf with its siblings and shape.

    ``tops`` holds tree, level, siblings, shape: the proof of each tree's root
    (empty where the root is the end).  ``payload`` names the leaf columns that
    ``emit`` sees beside tree, pos, n and digest.
    """
    spark = tops.sparkSession
    kinds = {f.name: f.dataType for f in forest.levels[0].schema.fields}
    above = None
    for k in reversed(range(max(1, len(forest.levels) - 1))):
        mine = payload if k == 0 else []
        root = tops.filter(F.col("level") == k + 1 if k else F.col("level") <= 1)
        heads = root.select("tree", F.lit(0).cast("long").alias("block"), "siblings", "shape")
        if above is not None:
            heads = heads.unionByName(above.select("tree", F.col("pos").alias("block"), "siblings", "shape"))
        nodes = forest.levels[k] if k == 0 else forest.levels[k].filter("n > 1")
        nodes = _blocks(nodes.select("tree", "pos", "n", "digest", *mine), forest.stride)
        blank = {f: F.lit(None).cast(kinds[f]) for f in ("pos", "n", "digest", *mine)}
        both = nodes.withColumns({"siblings": F.lit(None).cast("binary"), "shape": F.lit(None).cast("binary")}).unionByName(
            heads.select("*", *[v.alias(f) for f, v in blank.items()])
        )
        if k == 0:
            return _dealt(both).mapInArrow(_extract(forest.stride, emit), schema)
        above = _dealt(both).mapInArrow(
            _extract(forest.stride, plain), "tree string, pos long, siblings binary, shape binary"
        )
    return spark.createDataFrame([], schema)


def plain(nodes: pa.Table, siblings: list[bytes], shapes: list[bytes]) -> pa.RecordBatch:
    """tree, pos, siblings and shape, as they are."""
    return pa.RecordBatch.from_arrays(
        [
            pa.chunked_array(nodes.column("tree").chunks, pa.string()).combine_chunks(),
            pa.chunked_array(nodes.column("pos").chunks, pa.int64()).combine_chunks(),
            pa.array(siblings, pa.binary()), pa.array(shapes, pa.binary()),
        ],
        names=["tree", "pos", "siblings", "shape"],
    )


@dataclass
class Manifest:
    """The written levels of a dataset's trees and its root."""

    sources: Forest  # a tree a source; leaves carry doc_id and ``changed``
    top: Forest  # the tree of their roots; leaves carry source and level
    root: bytes | None  # None for an empty dataset


def build_manifest(docs: DataFrame, changed: Column | None = None, stride: int = STRIDE) -> Manifest:
    """Manifest of ``docs`` (doc_id, source, lang, n_chars, text; others are ignored).

    Null fields hash as ``-``.  Rows of a source are ordered by id, null first,
    then by their leaf, so repeated rows are leaves side by side.  An empty
    table has no root.  ``changed`` is a text to hash instead of the row's own
    into a second digest (null: none), for checks of later versions.  Only
    digests leave the scan; texts are never moved.
    """
    spark = docs.sparkSession
    own = [F.col(f"`{c}`") for c in FIELDS]
    other = F.lit(None).cast("binary") if changed is None else F.when(changed.isNotNull(), leaf_hash([*own[:-1], changed]))
    leaves = docs.select(
        own[1].cast("string").alias("tree"), own[0].cast("long").alias("doc_id"),
        leaf_hash(own).alias("digest"), other.alias("changed"),
    )
    line = placed(stage(leaves, "merkle-leaves"), ["tree", "doc_id", "digest"], "merkle")
    sources = build(stage(line, "merkle-level0"), stride)
    subroots = stage(sources.roots(), "merkle-subroots").select(
        F.lit(None).cast("string").alias("tree"), F.col("tree").alias("source"), "level", "digest"
    )
    top = build(stage(placed(subroots, ["tree", "source"], "merkle-top"), "merkle-top0"), stride, "merkle-top")
    root = top.roots().first()
    return Manifest(sources, top, bytes(root["digest"]) if root else None)


def _tops(nodes: pa.Table, siblings: list[bytes], shapes: list[bytes]) -> pa.RecordBatch:
    columns = [nodes.column("source").combine_chunks(), nodes.column("level").combine_chunks(), nodes.column("digest").combine_chunks()]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(siblings, pa.binary()), pa.array(shapes, pa.binary())],
        names=["tree", "level", "subroot", "siblings", "shape"],
    )


def source_tops(manifest: Manifest) -> DataFrame:
    """Per source: tree (the source), level, subroot and the subroot's own proof."""
    spark = manifest.top.levels[0].sparkSession
    ends = manifest.top.roots().select("tree", "level").withColumns(
        {"siblings": F.lit(b"").cast("binary"), "shape": F.lit(b"").cast("binary")}
    )
    schema = "tree string, level int, subroot binary, siblings binary, shape binary"
    found = proofs(manifest.top, ends, _tops, schema, ["source", "level"])
    return stage(found, "merkle-tops") if manifest.root else spark.createDataFrame([], schema)


def document_proofs(manifest: Manifest, emit: Emit | None = None, schema: str | None = None) -> DataFrame:
    """Proof of every document: source, doc_id, leaf, changed, siblings, shape (see :func:`fold`).

    ``emit`` turns the proofs of a task's rows into other rows of ``schema``
    there and then, so that long proofs need not leave it.
    """
    tops = source_tops(manifest)
    return proofs(
        manifest.sources, tops, emit or _whole,
        schema or "source string, doc_id long, leaf binary, changed binary, siblings binary, shape binary",
        ["doc_id", "changed"],
    )


def _whole(nodes: pa.Table, siblings: list[bytes], shapes: list[bytes]) -> pa.RecordBatch:
    columns = [nodes.column(c).combine_chunks() for c in ("tree", "doc_id", "digest", "changed")]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(siblings, pa.binary()), pa.array(shapes, pa.binary())],
        names=["source", "doc_id", "leaf", "changed", "siblings", "shape"],
    )


def checked(root: bytes | None) -> Emit:
    """Emit of :func:`verify`."""

    def emit(nodes: pa.Table, siblings: list[bytes], shapes: list[bytes]) -> pa.RecordBatch:
        leaves = nodes.column("digest").to_pylist()
        later = nodes.column("changed").to_pylist()
        folded = [fold(c if c is not None else d, s, f) for d, c, s, f in zip(leaves, later, siblings, shapes)]
        return pa.RecordBatch.from_arrays(
            [
                nodes.column("tree").combine_chunks(), nodes.column("doc_id").combine_chunks(),
                pa.array([d.hex() for d in leaves]),
                pa.array([hashlib.sha256(s.hex().encode()).hexdigest() for s in siblings]),
                pa.array([f.hex() for f in folded]), pa.array([f == root for f in folded]),
            ],
            names=["source", "doc_id", "leaf", "proof_sha256", "folded_root", "verified"],
        )

    return emit


def verify(manifest: Manifest) -> DataFrame:
    """Per document: source, doc_id, leaf, proof_sha256, folded_root, verified.

    The root is folded from the changed leaf where there is one, with the
    siblings of the manifest.
    """
    schema = "source string, doc_id long, leaf string, proof_sha256 string, folded_root string, verified boolean"
    return document_proofs(manifest, checked(manifest.root), schema)
