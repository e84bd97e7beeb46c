"""Language model, language identification and quality classifier."""

import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.llm import kernels as K
from emberline.llm.language_id import UNKNOWN, identify, keep_known, ngrams
from emberline.llm.lm_scoring import VALUE, Filter, _fit_shares, level, score
from emberline.llm.quality import BINS, FIELDS, WORDS, FactorisationMachine, classify, fit, values
from emberline.llm.queries import QUERIES, fold
from emberline.sources.staging import stage


def test_base_scores(spark, documents):
    rows = {r.doc_id: r for r in score(documents, fold(5) != 1).collect()}
    texts = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in documents.select("doc_id", "text").collect()]
    counts = Counter()
    for d, w in texts:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for d, w in texts:
        r = rows[d]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, len(w), sum(counts[x] > 0 for x in w))
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    held = [r for d, r in rows.items() if zlib.crc32(str(d).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tail_words_are_joined(spark, documents, monkeypatch):
    whole = {r.doc_id: r for r in score(documents, fold(5) != 1).collect()}
    monkeypatch.setattr("emberline.llm.lm_scoring.HEAD_WORDS", 50)
    for r in score(documents, fold(5) != 1).collect():
        assert r.n_known == whole[r.doc_id].n_known
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score, abs=1e-6)


def test_levels_bracket_counts():
    n = np.arange(1, 5000)
    q = level(n)
    assert (np.diff(q) >= 0).all() and q[0] == 1 and level(np.array([2]))[0] == 3
    assert Filter(4, 1024, np.zeros((16, 128), np.uint8)).levels(np.arange(9, dtype=np.uint64), 1).tolist() == [0] * 9
    assert Filter(4, 1024, np.full((16, 128), 255, np.uint8)).levels(np.arange(9, dtype=np.uint64), 0).min() > 90


def brute_scores(rows):
    """Scores with exact levels of every n-gram and shares fitted on all training texts; rows of (id, text, training)."""
    docs = [(d, ["<", *(t or "").encode().lower().split(), ">"], k) for d, t, k in rows]
    words, pairs = Counter(), Counter()
    for _, w, k in docs:
        if k:
            words.update(w[1:])
            pairs.update(zip(w, w[1:]))
    n, v, lv = sum(words.values()), len(words), lambda c: int(level(np.array([c]))[0]) if c else 0
    first = sum(k for _, _, k in docs)

    def parts(a, b, out):
        of = VALUE[lv(words[a])] if a != "<" else first
        both = max(VALUE[lv(pairs[a, b])] - out, 0)
        pair = min(1, both / max(of - out, 1)) if of > out else 0
        at = lv(words[a]) if a != "<" else lv(first)
        return at, pair, (max(VALUE[lv(words[b])] - out, 0) + 0.5) / (n + 0.5 * (v + 1))

    cells = Counter()
    for _, w, k in docs:
        for a, b in zip(w, w[1:]) if k else ():
            at, pair, single = parts(a, b, 1)
            ratio = int(np.clip(np.round(4 * np.log2(pair / single)), -120, 120)) if pair else -128
            cells[at * 512 + ratio + 128] += 1
    share = _fit_shares([{"key": k, "n": c} for k, c in cells.items()])
    total = lambda w: sum(math.log10(share[x] * p + (1 - share[x]) * s) for x, p, s in (parts(a, b, 0) for a, b in zip(w, w[1:])))
    return {d: total(w) for d, w, _ in docs}


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}


def test_lm_gives_disk_back_and_stages_no_ngrams(spark, documents, monkeypatch):
    """What stays after the scores are made: the texts without their n-grams, and no shuffle but that of the rows asked for."""
    import emberline.llm.lm_scoring as lm

    staged = {}
    monkeypatch.setattr(lm, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    before = _shuffle_files(spark)
    lm.score(documents, F.col("doc_id") % 5 != 1, max_bits=1)
    for _ in range(50):  # files are deleted in the background
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert staged["blocks"].count() == documents.count()


def test_lm_blocks_may_be_cut(spark, documents):
    """A block that comes in several batches asks in several runs; the scores are those of one run."""
    from emberline.llm.lm_scoring import score

    training, key = F.col("doc_id") % 5 != 1, "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = documents.coalesce(1)
    want = sorted((tuple(r) for r in score(docs, training).collect()), key=str)
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "7")
        got = sorted((tuple(r) for r in score(docs, training, max_bits=1).collect()), key=str)
    finally:
        spark.conf.set(key, old)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("max_bits", [None, 1000])
def test_lm_counts_every_pair_at_every_size(spark, monkeypatch, max_bits):
    """Broadcast and in parts: no level left out, pairs seen once kept, shares fitted on all texts."""
    monkeypatch.setattr("emberline.llm.lm_scoring.PER_ITEM", 1000)  # no false positives
    rng = np.random.default_rng(13)
    p = 1 / np.arange(1, 601)
    rows = [(i, " ".join(f"w{x}" for x in rng.choice(600, 25, p=p / p.sum())), bool(i % 5)) for i in range(1500)]
    rows += [(5001, "w0 once w1", True), (5002, "once w1", False), (5003, None, True), (5004, "never w0", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k boolean").repartition(3)
    got = {r.doc_id: r.score for r in score(docs, F.col("k"), max_bits=max_bits).collect()}
    want = brute_scores(rows)
    assert set(got) == set(want) and all(got[d] == pytest.approx(want[d], rel=1e-6) for d in want)


def test_lm_in_parts(awkward, empty, documents):
    for docs, training in ((awkward, F.col("doc_id") % 2 == 0), (empty, F.lit(True)), (documents, fold(5) != 1)):
        whole, parts = (
            sorted((tuple(r) for r in score(docs, training, max_bits=b).collect()), key=str) for b in (None, 1)
        )
        assert len(whole) == len(parts)
        for a, b in zip(whole, parts):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_lm_asks_of_a_part_are_probed_together(monkeypatch):
    """Hundreds of small asks: one look-up a kind, cut where they hold many keys, with the levels of each key alone."""
    import emberline.llm.lm_scoring as lm

    rng = np.random.default_rng(5)
    key, n = np.unique(rng.integers(0, 2**48, 3000, np.uint64)), rng.integers(1, 500, 3000).astype(np.uint32)
    counted = pa.RecordBatch.from_pylist([{"part": 0, "kind": 1, "keys": lm._pack(0, 1, key, n)[2], "counts": n.tobytes()}])
    segments = pa.table(pa.Table.from_batches(list(lm._segment_batches(4, 1 << 18)([counted]))))
    cuts = np.split(np.append(key, rng.integers(0, 2**48, 500, np.uint64)), np.sort(rng.integers(0, 3500, 300)))
    asked = pa.Table.from_pylist(
        [{"block": i, "row": i, "part": 0, "kind": i % 2, "keys": lm._pack(0, 1, k, k)[2]} for i, k in enumerate(cuts)]
    )
    one = Filter(4, 1 << 18, np.frombuffer(segments["segment"][0].as_buffer(), np.uint8).reshape(1, -1))
    want = [one.levels_at(np.zeros(len(k), np.int64), k, i % 2).tolist() for i, k in enumerate(cuts)]
    calls, probe = [], Filter.levels_at
    monkeypatch.setattr(Filter, "levels_at", lambda *a: calls.append(len(a[2])) or probe(*a))
    for most, rounds in ((1 << 20, 2), (1000, 6)):
        monkeypatch.setattr(lm, "ASKED_KEYS", most, raising=False)
        calls.clear()
        said = lm._look_up(4, 1 << 18)(asked, segments)
        assert [list(x.as_py()) for x in said["levels"]] == want and len(calls) <= rounds


def test_lm_awkward(awkward, empty):
    rows = score(awkward, F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == awkward.count()
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert score(empty, F.lit(True)).count() == 0
    none = score(awkward, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and {r.n_known for r in none} == {0}
    assert all(r.base_score == 0 for r in none)


def test_ngrams_stay_in_their_row():
    raw = ["abc", "", "a-b", "ÄÖ"]
    data = [t.encode() for t in raw]
    grams, first = ngrams(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert np.diff(first).tolist() == [3, 0, 3, 2]
    alone, _ = ngrams(np.frombuffer("äö".encode(), np.uint8), np.array([0, 4]))
    assert (grams[:, -2:] == alone).all()


def test_language_held_out(documents):
    found = identify(documents, fold(4) != 2).withColumnRenamed("score", "p")
    rows = found.join(documents.select("doc_id", "lang"), "doc_id").filter(fold(4) == 2).collect()
    good = [r for r in rows if r.lang_pred != UNKNOWN]
    assert sum(r.lang == r.lang_pred for r in good) >= 0.9 * len(good) and len(good) > 0.9 * len(rows)
    assert all(0 <= r.p <= 1 for r in rows)


def test_language_of_few_rows(spark, monkeypatch):
    """A language far below the sample's rate keeps its class."""
    monkeypatch.setattr("emberline.llm.language_id.SAMPLE", 60)
    rng = np.random.default_rng(14)
    words = {"en": "the and of with house water".split(), "de": "und der die nicht straße wasser".split(), "el": "και στο νερό σπίτι δρόμος".split()}
    langs = ["en", "de"] * 1500 + ["el"] * 12
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = identify(docs, F.col("doc_id") % 4 != 2).join(docs, "doc_id").filter("lang = 'el'").collect()
    assert [r.lang_pred for r in got] == ["el"] * 12


def test_language_awkward(awkward, empty):
    rows = identify(awkward, F.lit(True)).collect()
    assert len(rows) == awkward.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (3, 4, 5, 6)} == {(UNKNOWN, 0.0)}
    assert {r.lang_pred for r in rows} <= {UNKNOWN, "en", "de", "fr"}
    kept = keep_known(awkward, F.lit(True), least=0.0)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(r.lang_pred != UNKNOWN for r in rows)
    assert identify(empty, F.lit(True)).count() == 0 == keep_known(empty, F.lit(True)).count()
    assert {r.lang_pred for r in identify(awkward, F.lit(False)).collect()} == {UNKNOWN}


def test_machine_sums_all_pairs():
    rng = np.random.default_rng(3)
    size = WORDS + BINS * FIELDS
    m = FactorisationMachine(0.3, rng.normal(size=size), rng.normal(size=(size, 4)))
    idx = rng.integers(0, size, FIELDS + 9)
    x = values(len(idx))
    want = 0.3 + x @ m.w[idx]
    for i in range(len(idx)):
        for j in range(i):
            want += x[i] * x[j] * (m.v[idx[i]] @ m.v[idx[j]])
    assert m.margin([idx, idx])[1] == pytest.approx(want)


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2, 800), rng.integers(0, 2, 800)
    rows = [np.array([WORDS + BINS * f + (x if f == 0 else y if f == 1 else 0) for f in range(FIELDS)]) for x, y in zip(a, b)]
    model = fit(rows, (a ^ b).astype(float), epochs=30)
    assert ((model.probability(rows) > 0.5) == (a ^ b)).mean() > 0.95


def test_quality_held_out(spark, sf_dir):
    rows = QUERIES["op4_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.8 * len(rows)


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 5), (5, 0, 5), (6, None, 5), (None, 1, 5), (5, 0, 5)], "doc_id long, quality int, t int")
    rows = classify(awkward, labels, F.lit(True)).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert classify(empty, labels, F.lit(True)).count() == 0
    assert {r.score for r in classify(awkward, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_sums_of_empty_rows():
    assert K.sums(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3, 3])).tolist() == [0, 3, 0, 3, 0]
