"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training documents.  The weights are
fitted with follow-the-regularised-leader and an elastic-net penalty on a
sample of bounded size with a least number of each language, then a temperature is fitted on documents the weights have not
seen.  The model is a table of fixed size, so it is broadcast.
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
from emberline.llm.sampling import sample_by_group

BUCKETS = 1 << 15
SAMPLE = 3000  # labelled documents the weights are fitted on
LEAST = 50  # of them in each language, or all it has
SCALE = 100.0  # brings relative frequencies to the order of 1
UNKNOWN = "und"

_fold: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Letters as their lower case, everything else as a space."""
    if not _fold:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                table[c] = ord(s.lower()[0])
        _fold.append(table)
    return _fold[0]


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (3, n) of the 1-, 2- and 3-grams that start at each kept character, and row offsets.

    Runs of other characters than letters count as one space.
    """
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    first = at[offsets]
    c = _folded()[chars]
    keep = c != 32
    keep[1:] |= c[:-1] != 32
    starts = first[:-1][first[:-1] < len(c)]
    keep[starts] = c[starts] != 32
    kept = np.zeros(len(c) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    first = kept[first]
    c = c[keep]
    n = len(c)
    x = np.full((3, n + 2), 32, np.uint32)
    x[:, :n] = c
    # what lies beyond the end of a row counts as a space
    end = np.zeros(n + 2, bool)
    end[first[1:][first[1:] > 0] - 1] = True
    one = x[0, 1 : n + 1].copy()
    one[end[:n]] = 32
    two = x[0, 2 : n + 2].copy()
    two[end[:n] | end[1 : n + 1]] = 32
    a = c * np.uint32(0x9E3779B1)
    b = a ^ (one * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))
    d = b ^ (two * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F))
    out = np.empty((3, n), np.int64)
    for k, h in enumerate((a, b, d)):
        h = h ^ (h >> np.uint32(15))
        h = h * np.uint32(0x2C1B3C6D)
        out[k] = h >> np.uint32(17)
    return out, first


@dataclass
class LanguageModel:
    classes: list[str]
    table: np.ndarray  # (BUCKETS, classes): weight times inverse document frequency
    bias: np.ndarray
    temperature: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, has a letter) of each row."""
        grams, first = ngrams(data, offsets)
        total = self.table[grams[0]]
        total += self.table[grams[1]]
        total += self.table[grams[2]]
        n = np.diff(first)
        logits = K.sums(total, first).astype(np.float64) * (SCALE / np.maximum(3 * n, 1))[:, None]
        return softmax((logits + self.bias) / self.temperature), n > 0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(BUCKETS, np.int64)
    docs = 0
    for batch in batches:
        data, offsets = K.utf8(batch.column(0))
        for lo, hi in K.slices(offsets):
            at = offsets[lo : hi + 1]
            grams, first = ngrams(data[at[0] : at[-1]], at - at[0])
            for s, e in zip(first[:-1], first[1:]):
                here = np.zeros(BUCKETS, bool)
                here[grams[:, s:e]] = True
                seen += here
            docs += hi - lo
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(seen[used], docs))], names=["bucket", "n"]
    )


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.utf8(batch.column(1))
        out = []
        for lo, hi in K.slices(offsets):
            at = offsets[lo : hi + 1]
            grams, first = ngrams(data[at[0] : at[-1]], at - at[0])
            for s, e in zip(first[:-1], first[1:]):
                idx, n = np.unique(grams[:, s:e], return_counts=True)
                out.append(np.stack([idx, n]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "x"])


@dataclass
class _Features:
    """Class, buckets and TF-IDF values of each sampled text; the last bucket is the bias."""

    label: list[int]
    cut: np.ndarray
    counts: np.ndarray
    idf: np.ndarray

    def __getitem__(self, i: int) -> tuple[int, np.ndarray, np.ndarray]:
        idx, n = self.counts[:, self.cut[i] : self.cut[i + 1]]
        return self.label[i], np.append(idx, BUCKETS), np.append(SCALE * n / n.sum() * self.idf[idx], 1.0)


def _fit(features: _Features, rows: list[int], n_classes: int, epochs: int = 3):
    """Weights and bias by follow-the-regularised-leader with L1 and L2 penalties."""
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.001
    z = np.zeros((BUCKETS + 1, n_classes))
    s = np.zeros((BUCKETS + 1, n_classes))

    def weights(zi, si):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(si)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(rows):
            y, idx, x = features[i]
            zi, si = z[idx], s[idx]
            w = weights(zi, si)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            s[idx] = si + g * g
            z[idx] = zi + g - (np.sqrt(si + g * g) - np.sqrt(si)) / alpha * w
    w = weights(z, s)
    return w[:BUCKETS], w[BUCKETS]


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, training: Column) -> LanguageModel | None:
    """Model from the rows of ``training`` with a language; None if there are none."""
    rows = docs.filter(training & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    counts = (
        rows.select(F.col(f"`{text_col}`").cast("string"))
        .mapInArrow(_frequency_batches, "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    )
    lettered = rows.filter(F.col(f"`{text_col}`").cast("string").rlike("\\p{L}"))  # others have no n-grams
    few = sample_by_group(lettered, F.col(f"`{id_col}`"), F.col(f"`{lang_col}`").cast("string"), SAMPLE, LEAST)
    sample = (
        few.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("t"))
        .mapInArrow(_feature_batches, "lang string, x binary").collect()
    )
    sample.sort(key=lambda r: (r["lang"], r["x"]))
    sample = [sample[i] for i in np.random.default_rng(3).permutation(len(sample))]
    langs = [r["lang"] for r in sample if len(r["x"])]
    if not langs:
        return None
    # two joined arrays instead of thousands of small ones
    cut = np.cumsum([0, *[len(r["x"]) // 8 for r in sample if len(r["x"])]])
    joined = np.empty((2, cut[-1]), np.int32)
    for k, x in enumerate(r["x"] for r in sample if len(r["x"])):
        joined[:, cut[k] : cut[k + 1]] = np.frombuffer(x, np.int32).reshape(2, -1)
    del sample
    frequency = np.zeros(BUCKETS)
    total = 1
    for r in counts:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            frequency[r["bucket"]] = r["n"]
    idf = np.log((1 + total) / (1 + frequency)) + 0.1
    classes = sorted(set(langs))
    number = {c: i for i, c in enumerate(classes)}
    features = _Features([number[lang] for lang in langs], cut, joined, idf)
    every = range(len(langs))
    # every fifth of a language is held out, so a class of few examples keeps them for its weights
    apart, seen = set(), dict.fromkeys(classes, 0)
    for i, lang in enumerate(langs):
        seen[lang] += 1
        if seen[lang] % 5 == 0 and len(langs) >= 20:
            apart.add(i)
    held = [features[i] for i in (sorted(apart) or every)]
    w, bias = _fit(features, [i for i in every if i not in apart], len(classes))
    full = np.vstack([w, bias])
    logits = np.array([x @ full[idx] for _, idx, x in held])
    y = np.array([f[0] for f in held])
    grid = np.exp(np.linspace(np.log(0.2), np.log(20), 60))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return LanguageModel(classes, (w * idf[:, None]).astype(np.float32), bias, float(grid[int(np.argmin(loss))]))


def _score_batches(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel | None = pickle.loads(held.value)
        for batch in batches:
            column = batch.column(1)
            data, offsets = K.utf8(column)
            lang, score = [], []
            if model is None:
                lang, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for lo, hi in K.slices(offsets) if model is not None else ():
                at = offsets[lo : hi + 1]
                p, letters = model.probabilities(data[at[0] : at[-1]], at - at[0])
                best = p.argmax(axis=1)
                lang += [model.classes[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                score += np.where(letters, p[np.arange(len(best)), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def identify(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs``.

    The model learns from the rows where ``training`` holds.  Null texts and
    texts without a letter are `und` with score 0; so is every row if nothing
    is labelled.  Equal probabilities go to the first language by name.  Null
    and repeated ids are scored row by row; an empty table gives no rows; other
    columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(train(docs, id_col, text_col, lang_col, training)))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.mapInArrow(_score_batches(model), "doc_id long, lang_pred string, score double")


def keep_known(
    docs: DataFrame, training: Column, least: float = 0.3, found_col: str | None = None, **columns
) -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of at least ``least``, all columns.

    Language and text are read from the row itself, so null and repeated ids do
    not matter.  Null texts and texts without a letter go.  Where no row is
    labelled nothing can be told of any language: all rows stay as they are.
    The column ``found_col`` then holds the language found.
    """
    text, lang = columns.get("text_col", "text"), columns.get("lang_col", "lang")
    id_col = columns.get("id_col", "doc_id")
    fitted = train(docs, id_col, text, lang, training)
    K.release()  # what the fit took of the driver's memory; later stages run in the same session
    if fitted is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fitted))
    # marked as not to be repeated: the filter would else run it a second time, in a second worker
    found = F.pandas_udf(_language_udf(model), "struct<lang_pred: string, score: double>").asNondeterministic()
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    scored = rows.select("_row", found("_text").alias("_found"))
    good = scored.filter((F.col("_found.lang_pred") != UNKNOWN) & (F.col("_found.score") >= least))
    if found_col is None:
        return good.select("_row.*")
    return good.select(*[F.col("_found.lang_pred" if c == found_col else f"_row.`{c}`").alias(c) for c in docs.columns])


def _language_udf(held):
    import pandas as pd

    score = _score_batches(held)

    def run(texts: pd.Series) -> pd.DataFrame:
        column = pa.array(texts, pa.string(), from_pandas=True)
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), column], names=["doc_id", "t"])
        return next(score(iter([batch]))).to_pandas()[["lang_pred", "score"]]

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return run
