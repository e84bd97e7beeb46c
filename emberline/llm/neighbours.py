"""Approximate nearest neighbours: a forest of hash-prefix trees.

Each tree gives every vector a string of HASH_BITS sign bits of random
projections, and a sorted array of those strings is the tree.  A query first
descends: per tree it finds the longest prefix it shares with any string.  Then
all trees ascend together, one bit at a time, and the strings below the shared
prefix become candidates, until there are enough.

Vectors are dealt into shards of about SHARD rows, queries into blocks; a cell
holds one shard and one block, so its size does not grow with the table.  The
candidates are compared in double precision on the original vectors and the
best of each shard are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 8192
BLOCK = 2048
TREES = 64
HASH_BITS = 24
ENOUGH = 6000  # strings met over all trees before a query stops its ascent in a shard


def hashes(x: np.ndarray, trees: int = TREES, bits: int = HASH_BITS, seed: int = 5) -> np.ndarray:
    """Hash strings (trees, rows) as integers, first bit highest."""
    rng = np.random.default_rng(seed)
    weight = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
    planes = rng.normal(size=(trees, x.shape[1], bits))
    return np.stack([(x @ p > 0) @ weight for p in planes])


def candidates(strings: np.ndarray, order: np.ndarray, query: np.ndarray, enough: int, bits: int = HASH_BITS) -> list[np.ndarray]:
    """Row numbers met by each query; ``strings`` (trees, rows) is sorted by ``order`` in each tree."""
    trees, n_queries = query.shape
    low = np.zeros((bits + 1, trees, n_queries), np.int64)
    high = np.zeros_like(low)
    for t in range(trees):
        for drop in range(bits + 1):
            prefix = (query[t] >> drop) << drop
            low[drop, t] = np.searchsorted(strings[t], prefix, "left")
            high[drop, t] = np.searchsorted(strings[t], prefix + (1 << drop), "left")
    met = (high - low).sum(axis=1)  # (bits + 1, queries), grows with the bits dropped
    stop = np.minimum((met < min(enough, trees * strings.shape[1])).sum(axis=0), bits)
    out = []
    for i in range(n_queries):
        a, b = low[stop[i], :, i], high[stop[i], :, i]
        out.append(np.unique(np.concatenate([order[t, x:y] for t, (x, y) in enumerate(zip(a, b))])))
    return out


FOUND = "query_id long, vec_id long, score double"


def _once(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id, those that repeat an id with the same vector once."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    keep = np.ones(len(ids), bool)
    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(ids)))
    for s, n in zip(begin[size > 1], size[size > 1]):
        keep[s : s + n] = False
        keep[s + np.unique(x[s : s + n], axis=0, return_index=True)[1]] = True
    return x[keep], ids[keep]


def _search(k: int, trees: int, enough: int):
    def search(table: pa.Table) -> pa.Table:
        is_query = np.asarray(table.column("is_query").to_numpy())
        ids = table.column("vec_id").to_numpy()
        vectors = table.column("x").combine_chunks()
        size = len(vectors[0])
        x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)
        q, q_ids = _once(x[is_query], ids[is_query])
        p, p_ids = _once(x[~is_query], ids[~is_query])
        if len(q) == 0 or len(p) == 0:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        # equal vectors are one leaf, so a common one does not crowd out others
        _, first, leaf = np.unique(p, axis=0, return_index=True, return_inverse=True)
        leaf = leaf.reshape(-1)
        members = np.argsort(leaf, kind="stable")  # by leaf, then by id
        begin = np.searchsorted(leaf[members], np.arange(len(first) + 1))
        distinct = p[first]
        middle = np.median(distinct, axis=0)
        length = lambda v: np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300)
        tree = hashes((distinct - middle) / length(distinct - middle), trees)
        order = np.argsort(tree, axis=1, kind="stable")
        tree = np.take_along_axis(tree, order, axis=1)
        out_q, out_p, out_s = [], [], []
        step = 256
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            met = candidates(tree, order, hashes((part - middle) / length(part - middle), trees), enough)
            for row, own, found in zip(part, q_ids[lo : lo + step], met):
                d = np.sqrt(((distinct[found] - row) ** 2).sum(axis=1))
                near = np.argsort(d, kind="stable")
                if len(near) > k + 1:  # ties of the last place stay
                    near = near[d[near] <= d[near[k]]]
                hit_ids, hit_d = [], []
                for c in near:
                    rows = members[begin[found[c]] : begin[found[c] + 1]][: k + 1]
                    hit_ids.append(p_ids[rows])
                    hit_d.append(np.full(len(rows), d[c]))
                i, s = np.concatenate(hit_ids), np.concatenate(hit_d)
                i, s = i[i != own], s[i != own]
                best = np.lexsort((i, s))[:k]
                out_q.append(np.full(len(best), own))
                out_p.append(i[best])
                out_s.append(s[best])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_p), "score": np.concatenate(out_s)})

    return search


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    shard: int = SHARD,
    block: int = BLOCK,
    trees: int = TREES,
    enough: int = ENOUGH,
) -> DataFrame:
    """The ``k`` nearest vectors found for each query: query_id, rank, vec_id, score.

    ``is_query`` is an expression of the id; every usable row is indexed, a
    query is no neighbour of its own id.  Score is the Euclidean distance.
    Ties go to the smaller id.  Vectors that are null, empty, zero or hold a
    null or non-finite component take no part, nor do rows without an id or
    with another number of components than most.  Rows that repeat an id count
    once if the vector is the same.  An empty table gives no rows; other
    columns are ignored.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & usable
    )
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), "size").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("x") == common["size"])
    n = common["n"]
    queries = rows.filter(is_query)
    n_queries = queries.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n_queries // block))
    deal = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    points = rows.select(
        deal(1, shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(False).alias("is_query"), "vec_id", "x",
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), deal(2, blocks).alias("block"),
        F.lit(True).alias("is_query"), "vec_id", "x",
    )
    found = points.unionByName(asked).groupBy("shard", "block").applyInArrow(_search(k, trees, enough), FOUND).distinct()
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")  # k rows of each shard
    return (
        found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
