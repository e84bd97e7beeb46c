"""Quality classifier: a factorisation machine on hashed words, structure and metadata.

The score is linear in the number of features: with s = sum of x_i v_i, the
sum of all pairwise terms is half of |s|^2 minus the sum of |x_i v_i|^2.  The
model has a fixed size and is broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm import kernels as K
from emberline.llm.sampling import bounded_sample

WORDS = 1 << 17
BINS = 32
FIELDS = 14
RANK = 8
SAMPLE = 20_000  # labelled documents the model is fitted on, at most
CUT = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = ~(_LETTER | _DIGIT | K.IS_SPACE)
_PLAIN = np.isin(np.arange(256), np.frombuffer(b".,;:!?'\"-()", np.uint8))
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bins of a share, finer near 0."""
    x = np.clip(a / np.maximum(b, 1), 0, 1)
    return np.minimum(BINS - 1, np.floor(np.sqrt(x) * BINS)).astype(np.int64)


def _size(a: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.floor(1.5 * np.log2(1 + np.maximum(a, 0)))).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of each row: first FIELDS structure features, then distinct hashed words."""
    w, first = K.words(data, offsets)
    lines, line_first = K.words(data, offsets, _LINE)
    n_bytes = np.diff(offsets)
    n_words = np.diff(first)
    n_lines = np.diff(line_first)
    count = lambda table: K.sums(table[data].astype(np.int64), offsets)
    letters, upper, digits, marks, plain = map(count, (_LETTER, _UPPER, _DIGIT, _MARK, _PLAIN))
    spaces = count(K.IS_SPACE)
    bucket = (w >> np.uint64(64 - 17)).astype(np.int64)
    rows_words = [np.unique(bucket[s:e], return_counts=True) for s, e in zip(first[:-1], first[1:])]
    distinct = np.array([len(u) for u, _ in rows_words], np.int64)
    top = np.array([c.max() if len(c) else 0 for _, c in rows_words], np.int64)
    lines_distinct = np.array([len(np.unique(lines[s:e])) for s, e in zip(line_first[:-1], line_first[1:])], np.int64)
    fields = [
        _size(n_words),
        _size(n_bytes / np.maximum(n_words, 1)),
        _share(letters, n_bytes),
        _share(upper, letters),
        _share(digits, n_bytes),
        _share(marks - plain, n_bytes),
        _share(plain, n_bytes),
        _share(spaces, n_bytes),
        _size(n_lines),
        _size(n_bytes / np.maximum(n_lines, 1)),
        _share(distinct, n_words),
        _share(top, n_words),
        _share(n_lines - lines_distinct, n_lines),
        _size(n_chars),
    ]
    fixed = np.stack(fields, axis=1) + WORDS + BINS * np.arange(FIELDS)
    return [np.concatenate([f, u]) for f, (u, _) in zip(fixed, rows_words)]


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        """Raw scores; one pass over the features of each row."""
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(r) for r in rows])
        idx = np.concatenate(rows)
        x = np.concatenate([values(n) for n in sizes])
        at = np.concatenate([[0], np.cumsum(sizes)])
        xv = x[:, None] * self.v[idx]
        s = K.sums(xv, at)
        return (
            self.bias
            + K.sums(x * self.w[idx], at)
            + 0.5 * ((s * s).sum(axis=1) - K.sums((xv * xv).sum(axis=1), at))
        )

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(rows) + self.shift, -30, 30)))


def values(n: int) -> np.ndarray:
    """Structure features count 1 each, the words together have length 1."""
    x = np.ones(n)
    if n > FIELDS:
        x[FIELDS:] = 1 / np.sqrt(n - FIELDS)
    return x


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 4) -> FactorisationMachine:
    """Model by AdaGrad on the logistic loss; slope and shift from rows left out."""
    rng = np.random.default_rng(11)
    size = WORDS + BINS * FIELDS
    base = float(np.clip(labels.mean(), 0.01, 0.99))
    model = FactorisationMachine(np.log(base / (1 - base)), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    many = len(rows) >= 50
    kept = [i for i in range(len(rows)) if i % 5 or not many]
    held = [i for i in range(len(rows)) if i % 5 == 0 or not many]
    gw, gv, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    rate, decay = 0.1, 1e-4
    w, v = model.w, model.v
    for _ in range(epochs):
        for i in rng.permutation(kept):
            idx = rows[i]
            x = values(len(idx))
            vi = v[idx]
            xv = x[:, None] * vi
            s = xv.sum(axis=0)
            score = model.bias + x @ w[idx] + 0.5 * (s @ s - (xv * xv).sum())
            g = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[i]
            dw = g * x + decay * w[idx]
            dv = g * x[:, None] * (s - xv) + decay * vi
            gw[idx] += dw * dw
            gv[idx] += dv * dv
            gb += g * g
            w[idx] -= rate * dw / np.sqrt(gw[idx])
            v[idx] = vi - rate * dv / np.sqrt(gv[idx])
            model.bias -= rate * g / np.sqrt(gb)
    # logistic calibration by Newton steps on the rows left out
    m, y = model.margin([rows[i] for i in held]), labels[held]
    a, b = 1.0, 0.0
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - y) * m).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        hess = np.array([[(h * m * m).sum() + 1e-2, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        a, b = float(np.clip(a - step[0], 0.1, 5)), float(np.clip(b - step[1], -5, 5))
    model.slope, model.shift = a, b
    model.w, model.v = w.astype(np.float32), v.astype(np.float32)
    return model


def _rows_of(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    data, offsets = K.utf8(batch.column(1))
    n_chars = np.asarray(batch.column(2).fill_null(0).to_numpy(zero_copy_only=False), np.float64)
    for lo, hi in K.slices(offsets):
        at = offsets[lo : hi + 1]
        yield features(data[at[0] : at[-1]], at - at[0], n_chars[lo:hi])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [r.astype(np.int32).tobytes() for rows in _rows_of(batch) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["y", "x"])


def _score_batches(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: FactorisationMachine = pickle.loads(held.value)
        for batch in batches:
            p = [model.probability(rows) for rows in _rows_of(batch)]
            score = np.concatenate(p) if p else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def classify(
    docs: DataFrame,
    labels: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str = "n_chars",
    label_col: str = "quality",
) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs``.

    Learns from the labelled rows where ``training`` (an expression of the id)
    holds.  Null and empty texts are scored by their structure; a null
    ``chars_col`` counts as 0; null labels are ignored.  Without any label the
    score is 0.5.  Null and repeated ids are scored row by row; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(f"`{id_col}`"), F.col(f"`{label_col}`").cast("long").alias("_y")).filter(
        training & F.col("_y").isNotNull() & F.col(f"`{id_col}`").isNotNull()
    )
    few = bounded_sample(marked, F.col(f"`{id_col}`"), SAMPLE).select(F.col(f"`{id_col}`").alias("_lid"), "_y")
    text = F.col(f"`{text_col}`").cast("string").alias("t")
    chars = F.col(f"`{chars_col}`").cast("double").alias("c")
    sample = (
        docs.join(F.broadcast(few), F.col(f"`{id_col}`") == F.col("_lid"))  # at most 2 * SAMPLE rows of two longs
        .select("_y", text, chars).mapInArrow(_feature_batches, "y long, x binary").limit(2 * SAMPLE).collect()
    )
    if sample:
        rows = sorted((r["x"], r["y"]) for r in sample)
        order = np.random.default_rng(3).permutation(len(rows))
        model = fit(
            [np.frombuffer(rows[i][0], np.int32).astype(np.int64) for i in order],
            np.array([min(1, max(0, rows[i][1])) for i in order], float),
        )
    else:
        size = WORDS + BINS * FIELDS
        model = FactorisationMachine(0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))
    held = spark.sparkContext.broadcast(pickle.dumps(model))
    scored = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text, chars).mapInArrow(
        _score_batches(held), "doc_id long, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
