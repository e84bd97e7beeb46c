"""Ranked lexical search with K2-treaps over the term-document grid.

Documents are indexed in blocks where they are read.  A block has a grid with
one row a distinct term (commonest first) and one column a document (shortest
first); a cell's value is the impact of the term in the document, in whole
numbers, before the term's own weight.  The grid is kept as a K2-treap.

An item is a set of terms.  In each block the row paths of its terms descend
jointly, best first over ranges of documents (see ``k2_treap.best_columns``);
the best of all blocks are then ranked.  Nothing of the corpus is gathered but
counts and at most k rows for each item and block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import kernels as K
from emberline.llm.k2_treap import K2Treap, best_columns, build
from emberline.sources.staging import new_path, stage

BLOCK_BYTES = 1 << 24  # of text in an index block
ITEM_BYTES = 1 << 20  # of item texts searched in one pass
ITEMS = 4096  # searched in one pass
GROUP_SLOTS = 4096  # items times the terms of the longest, descended together
UNIT = 1_000_000_000

#: bytes that stand between terms: ASCII without digits and letters
IS_GAP = np.ones(256, bool)
IS_GAP[128:] = False
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    IS_GAP[ord(_first) : ord(_last) + 1] = False


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.utf8(batch.column(0))
        full = terms = 0
        for lo, hi in K.slices(offsets):
            at = offsets[lo : hi + 1]
            _, first = K.word_starts(K.LOWER[data[at[0] : at[-1]]], at - at[0], IS_GAP)
            size = np.diff(first)
            full, terms = full + int((size > 0).sum()), terms + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array([full]), pa.array([terms])], names=["n", "l"])


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, terms with repeats) over all documents."""
    text = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    row = text.mapInArrow(_counts, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return row["n"] or 0, row["l"] or 0


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Whole-number impact of terms that occur ``tf`` times in documents of ``size`` terms."""
    whole, rest = divmod(90 * n_docs, n_terms)
    if len(size) and int(size.max()) * max(rest, whole) >= 1 << 62:  # beyond 64 bits on the way only
        part = np.array([s * rest // n_terms for s in size.tolist()], np.int64)
    else:
        part = size * rest // n_terms
    m = 100 - 90 + size * whole + part
    return UNIT * tf // (1000 * tf + 8 * m)


def distinct_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, term, times) of the distinct terms of each row, sorted, and the size of each row."""
    terms, first = K.words(data, offsets, IS_GAP)
    row = K.rows_of(first)
    order = np.lexsort((terms, row))
    terms, row = terms[order], row[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], terms[at], np.diff(np.append(at, len(terms))), np.diff(first)


INDEX = "terms binary, df binary, rows binary, ids binary, nameless binary, tree binary, n_docs int"


def _block(parts: list[tuple], ids: list[np.ndarray], nameless: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch | None:
    size = np.concatenate([p[3] for p in parts])
    start = np.cumsum([0, *(len(p[3]) for p in parts)])
    row = np.concatenate([p[0] + s for p, s in zip(parts, start)])
    term = np.concatenate([p[1] for p in parts])
    times = np.concatenate([p[2] for p in parts])
    ids, nameless = np.concatenate(ids), np.concatenate(nameless)
    if len(term) == 0:
        return None
    order = np.lexsort((ids, nameless, size))
    column = np.empty(len(order), np.int64)
    column[order] = np.arange(len(order))
    words, number, df = np.unique(term, return_inverse=True, return_counts=True)
    place = np.empty(len(words), np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(len(words))
    tree = build(place[number], column[row], impacts(times, size[row], n_docs, n_terms))
    parts = [words.astype("<u8"), df.astype("<u4"), place.astype("<u4"), ids[order].astype("<i8"), nameless[order]]
    columns = [pa.array([x.tobytes()], pa.binary()) for x in parts] + [pa.array([tree], pa.binary()), pa.array([len(ids)], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in INDEX.split(", ")])


def _index(n_docs: int, n_terms: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        ids: list[np.ndarray] = []
        nameless: list[np.ndarray] = []
        held = 0
        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            name = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            blank = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for lo, hi in K.slices(offsets, min(most, K.SLICE_BYTES)):
                at = offsets[lo : hi + 1]
                if held and held + at[-1] - at[0] > most:
                    if block := _block(parts, ids, nameless, n_docs, n_terms):
                        yield block
                    parts, ids, nameless, held = [], [], [], 0
                    K.release()
                parts.append(distinct_terms(data[at[0] : at[-1]], at - at[0]))
                ids.append(name[lo:hi])
                nameless.append(blank[lo:hi])
                held += at[-1] - at[0]
        if parts and (block := _block(parts, ids, nameless, n_docs, n_terms)):
            yield block
        K.release()

    return run


@dataclass
class Index:
    """Written index blocks with the size of the corpus."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> Index:
    """Index of all whole texts; each block is built in the task that reads its documents.

    Null and empty texts have no term and are not counted.  Rows without an id
    and repeated rows are documents of their own.  An empty table gives an
    index without blocks.  Other columns are ignored.
    """
    n_docs, n_terms = corpus_size(docs, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))
    blocks = rows.mapInArrow(_index(n_docs, n_terms, block_bytes), INDEX)
    return Index(stage(blocks, "lexical-index"), n_docs, n_terms)


def _matches(wanted: np.ndarray):
    """Documents of each wanted term (sorted) in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                terms, df = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((0, "<u8"), (1, "<u4")))
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                here = np.flatnonzero(terms[at] == wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(here), pa.array(df[at[here]].astype(np.int64))], names=["term", "df"]
                )

    return run


def _search(item: np.ndarray, term: np.ndarray, weight: np.ndarray, names: list[int | None], k: int):
    """``term`` is sorted within each of the ascending items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                terms, rows, ids, nameless, tree = (batch.column(c)[j].as_buffer() for c in range(5))
                terms, rows = np.frombuffer(terms, "<u8"), np.frombuffer(rows, "<u4")
                ids, nameless = np.frombuffer(ids, "<i8"), np.frombuffer(nameless, bool)
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                here = np.flatnonzero(terms[at] == term)
                opened = K2Treap.read(tree)
                out = []
                for lo, hi in _item_groups(item[here]):
                    part = here[lo:hi]
                    numbers, local = np.unique(item[part], return_inverse=True)
                    who, col, score = best_columns(opened, local, rows[at[part]].astype(np.int64), weight[part], ids, k)
                    out.append((numbers[who], col, score))
                who, col, score = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(who, pa.int64()), pa.array([names[w] for w in who.tolist()], pa.int64()),
                        pa.array(ids[col], pa.int64(), mask=nameless[col]), pa.array(score, pa.int64()),
                    ],
                    names=["number", "item_id", "doc_id", "score"],
                )
                K.release()

    return run


def _item_groups(item: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole items with at most GROUP_SLOTS cells of items times terms, or one item."""
    edge = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
    lo = count = widest = 0
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if count and (count + 1) * max(widest, b - a) > GROUP_SLOTS:
            yield lo, a
            lo, count, widest = a, 0, 0
        count, widest = count + 1, max(widest, b - a)
    if count:
        yield lo, len(item)


def _item_passes(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in bounded lists; a longer text is alone."""
    held, size = [], 0
    for row in items.distinct().toLocalIterator():
        text = row["t"] or ""
        if held and (size + len(text) > ITEM_BYTES or len(held) == ITEMS):
            yield held
            held, size = [], 0
        held.append((row["i"], text))
        size += len(text)
    if held:
        yield held


def _pass(index: Index, items: list[tuple[int | None, str]], k: int) -> DataFrame:
    data, offsets = K.utf8(pa.array([t for _, t in items], pa.large_string()))
    item, term, _, _ = distinct_terms(data, offsets)
    wanted, number = np.unique(term, return_inverse=True)
    counted = index.blocks.select("terms", "df").mapInArrow(_matches(wanted), "term long, df long")
    df = np.zeros(len(wanted), np.int64)
    for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # the pass's own terms at most
        df[row["term"]] = row["df"]
    weight = np.floor(1000 * np.log((2 * index.n_docs + 2) / (2 * df + 1))).astype(np.int64)
    use = (df[number] > 0) & (weight[number] > 0)
    found = index.blocks.select("terms", "rows", "ids", "nameless", "tree").mapInArrow(
        _search(item[use], term[use], weight[number][use], [i for i, _ in items], k),
        "number long, item_id long, doc_id long, score long",
    )
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score (above 0).

    Equal scores go by the smaller id, rows without an id last.  Items without
    a known term have no row; repeated items count once, and texts that share
    an item id are ranked each.  Items are searched in passes of bounded size.
    """
    asked = items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = "item_id long, rank int, doc_id long, score long"
    spark = items.sparkSession
    path, done = new_path(spark, "lexical-search"), False
    for part in _item_passes(asked) if index.n_terms else ():
        _pass(index, part, k).write.mode("append").parquet(path)
        done = True
    return spark.read.schema(schema).parquet(path) if done else spark.createDataFrame([], schema)
