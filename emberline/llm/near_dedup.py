"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find groups.

Documents with the same shingle set form one class at once; only one document
of a class goes on.  In each band bucket all members are compared with one
pivot, not with each other.  Members of a bucket that end in different
components afterwards are compared across those components, signature by
signature in blocks, so a link between two texts that both miss the pivot is
found too.  Every link is confirmed on the full sets of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import kernels as K
from emberline.llm.components import components
from emberline.sources.staging import stage

SHINGLE = 5
BANDS, ROWS = 32, 6  # a pair at 0.85 is missed with probability (1 - .85**6)**32 = 3e-7
THRESHOLD = 85  # per cent
BLOCK = 512  # members of a bucket that are compared with each other at once


def superminhash(elements: np.ndarray, rows: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Signatures (n_rows, m) of the sets given as elements and their rows.

    Each element walks a random permutation of the m slots; in step j it offers
    the value j + u to its j-th slot.  A row stops as soon as its largest slot
    value lies below the next step, because no later offer can be smaller.
    """
    sig = np.full(n_rows * m, np.inf)
    steps = np.arange(1, m + 1, dtype=np.uint64) * K.GOLDEN
    perm = None
    for j in range(m):
        if len(elements) == 0:
            break
        x = K.mix(elements + steps[j])
        u = (x >> np.uint64(32)).astype(np.float64) * 2.0**-32
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            i = np.arange(len(elements))
            slot = perm[i, k].astype(np.int64)
            perm[i, k] = perm[:, j]
        np.minimum.at(sig, rows * m + slot, u + j)
        going = (sig.reshape(n_rows, m).max(axis=1) >= j + 1)[rows]
        first = k if perm is None else None
        elements, rows = elements[going], rows[going]
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
            perm[np.arange(len(elements)), first[going]] = 0
        else:
            perm = perm[going]
    return sig.reshape(n_rows, m)


def _signature_batches(bands: int, per_band: int, size: int):
    m = bands * per_band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            for lo, hi in K.slices(offsets):
                at = offsets[lo : hi + 1]
                sets, first = K.shingles(data[at[0] : at[-1]], at - at[0], size)
                n = hi - lo
                row = K.rows_of(first)
                sig = superminhash(sets, row, n, m).view(np.uint64).reshape(n, bands, per_band)
                short = K.mix(sig.reshape(n, m)).astype(np.uint16)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * K.GOLDEN, (n, bands)).copy()
                for r in range(per_band):
                    key = K.mix(key + sig[:, :, r])
                count = np.diff(first)
                sums = []
                for salt in np.array([3, 5], np.uint64):
                    s = np.zeros(len(sets) + 1, np.uint64)
                    np.cumsum(K.mix((sets ^ salt) * K.GOLDEN), out=s[1:])
                    sums.append((s[first[1:]] - s[first[:-1]]).view(np.int64))
                per_row = np.where(count > 0, bands, 0)
                list_at = np.zeros(n + 1, np.int32)
                np.cumsum(per_row, out=list_at[1:])
                values = key[count > 0].reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array(count.astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.ListArray.from_arrays(pa.array(list_at), pa.array(values)),
                        pa.array([r.tobytes() for r in short], pa.binary()),
                    ],
                    names=["doc_id", "n", "k1", "k2", "bands", "sig"],
                )

    return run


def _sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    data, offsets = K.utf8(column)
    out: list[np.ndarray] = []
    for lo, hi in K.slices(offsets):
        at = offsets[lo : hi + 1]
        sets, first = K.shingles(data[at[0] : at[-1]], at - at[0], size)
        out += [sets[a:b] for a, b in zip(first[:-1], first[1:])]
    return out


def _similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= threshold * (len(x) + len(y) - common) and common > 0


def _jaccard_batches(size: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                pairs = zip(_sets_of(part.column(2), size), _sets_of(part.column(3), size))
                keep = pa.array([_similar(x, y, threshold) for x, y in pairs], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"]
                )

    return run


CELL = ["key", "i", "j", "block", "n", "c", "doc_id", "sig"]


def _near_in_cell(cell: dict[str, np.ndarray], threshold: int, low: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, other rows) of different components whose signatures agree in at least ``low`` slots."""
    i, j, block = cell["i"][0], cell["j"][0], cell["block"]
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    sig, n, c = cell["sig"], cell["n"], cell["c"]
    for x in left:
        to = right[(c[right] != c[x]) & (right > x if i == j else True)]
        to = to[100 * np.minimum(n[to], n[x]) >= threshold * np.maximum(n[to], n[x])]
        to = to[(sig[to] == sig[x]).sum(axis=1) >= low]
        if len(to):
            yield x, to


def _cells(batches: Iterator[pa.RecordBatch], names: list[str], m: int) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each (key, i, j), which stand together."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names if k != "sig"}
        rows["sig"] = K.utf8(batch.column("sig"))[0].view(np.uint16).reshape(-1, m)
        if held is not None:
            rows = {k: np.concatenate([held[k], rows[k]]) for k in names}
        change = np.zeros(len(rows["key"]) - 1, bool)
        for k in ("key", "i", "j"):
            change |= rows[k][1:] != rows[k][:-1]
        at = [0, *(np.flatnonzero(change) + 1).tolist()]
        for s, e in zip(at[:-1], at[1:]):
            yield {k: v[s:e] for k, v in rows.items()}
        held = {k: v[at[-1] :] for k, v in rows.items()}
    if held is not None:
        yield held


def _least_agreement(threshold: int, m: int) -> int:
    """Slots in which a pair at the threshold agrees, less five standard deviations."""
    t = threshold / 100
    return int(np.ceil(m * (t - 5 * np.sqrt(t * (1 - t) / m))))


def _candidate_batches(threshold: int, m: int):
    """Documents of a cell that have a candidate in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, CELL, m):
            rows: set[int] = set()
            for x, to in _near_in_cell(cell, threshold, _least_agreement(threshold, m)):
                rows.add(int(x))
                rows.update(to.tolist())
            if rows:
                ids = cell["doc_id"][sorted(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["doc_id"])

    return run


def _confirm_batches(size: int, threshold: int, m: int):
    """Links that join the components of a cell: a spanning forest of them, from full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, [*CELL, "text"], m):
            root = {c: c for c in cell["c"].tolist()}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            a, b = [], []
            sets: list[np.ndarray] | None = None
            for x, to in _near_in_cell(cell, threshold, _least_agreement(threshold, m)):
                if sets is None:
                    sets = _sets_of(pa.array(cell["text"], pa.string()), size)
                for y in to.tolist():
                    cx, cy = find(int(cell["c"][x])), find(int(cell["c"][y]))
                    if cx != cy and _similar(sets[x], sets[y], threshold):
                        root[max(cx, cy)] = min(cx, cy)
                        a.append(int(cell["doc_id"][x]))
                        b.append(int(cell["doc_id"][y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _dealt(rest: DataFrame, *columns: str) -> DataFrame:
    """Bucket members (with ``blocks`` of their bucket) dealt to cells of two blocks each.

    A bucket is dealt into blocks of about BLOCK members and each pair of blocks
    is a cell of its own, so no task holds a large bucket.
    """
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = rest.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    rows = rows.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "n", "c", "doc_id", "sig", *columns,
    )
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _linked(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_jaccard_batches(size, threshold), "a long, b long")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    per_band: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """Every row with the component of near copies it belongs to.

    Returns doc_id, n_shingles, component_id (smallest id reachable over links
    of at least ``threshold`` per cent), kept.  Null, empty and blank texts have
    no shingles and link with nothing.  Rows that repeat an id are compared by
    their own texts and are one node.  Rows without an id get a null component
    and stay.  An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")
    )
    sig = stage(
        base.mapInArrow(
            _signature_batches(bands, per_band, size),
            "doc_id long, n long, k1 long, k2 long, bands array<long>, sig binary",
        ),
        "signatures",
    )
    usable = sig.filter("n > 0 and doc_id is not null")
    classes = stage(usable.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("cls")), "classes")
    same = usable.join(classes, ["n", "k1", "k2"]).filter("doc_id <> cls").select(
        F.col("doc_id").alias("a"), F.col("cls").alias("b")
    )
    heads = usable.join(classes.toDF("n", "k1", "k2", "doc_id"), ["n", "k1", "k2", "doc_id"])
    banded = heads.select("doc_id", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(
        F.min("doc_id").alias("pivot"), F.min_by("n", "doc_id").alias("pn"), F.max("doc_id").alias("_last")
    ).filter("pivot <> _last").drop("_last")
    members = stage(banded.join(buckets, "key"), "members")
    alike = F.least("n", "pn") * 100 >= F.greatest("n", "pn") * threshold
    pairs = stage(
        members.filter((F.col("doc_id") != F.col("pivot")) & alike)
        .select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct(),
        "pairs",
    )
    # texts of the members of buckets: moved once, for both rounds of comparisons
    ends = members.select(F.col("doc_id").alias("_i")).distinct().hint("merge")
    texts = stage(base.join(ends, F.col("_id") == F.col("_i"), "left_semi"), "texts")
    links = stage(_linked(pairs, texts, size, threshold), "links")
    labels = components(links)
    # members of one bucket in different components: compare across them
    at = members.join(labels, F.col("doc_id") == F.col("node"), "left").select(
        "key", "doc_id", "n", F.coalesce("component", "doc_id").alias("c")
    )
    at = stage(at, "placed")
    mixed = at.groupBy("key").agg(
        F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count("*").alias("size")
    ).filter("_lo <> _hi").select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rest = stage(at.join(mixed, "key"), "rest")
    signed = rest.join(heads.select("doc_id", "sig"), "doc_id")
    near = _dealt(signed).mapInArrow(_candidate_batches(threshold, bands * per_band), "doc_id long")
    near = stage(near.distinct(), "candidates")
    checked = signed.join(near, "doc_id", "left_semi").join(texts.toDF("doc_id", "text"), "doc_id")
    cross = _dealt(checked, "text").mapInArrow(_confirm_batches(size, threshold, bands * per_band), "a long, b long")
    links = links.union(cross).union(same)
    labels = stage(components(links), "components")
    out = sig.select("doc_id", F.col("n").alias("n_shingles")).join(
        labels, F.col("doc_id") == F.col("node"), "left"
    )
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns.

    As :func:`near_groups`; rows that repeat an id stay or go together.
    """
    gone = stage(near_groups(docs, id_col, text_col, **options).filter("not kept").select(F.col("doc_id").alias("_gone")), "gone")
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
