"""K2-treap and ranked search against plain sums, and the word hash."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import kernels as K
from emberline.llm.k2_treap import K2Treap, best_columns, build
from emberline.llm.lexical_search import IS_GAP, build_index, impacts, search
from emberline.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def grid(seed):
    rng = np.random.default_rng(seed)
    rows, cols = int(rng.integers(1, 200)), int(rng.integers(1, 300))
    n = int(rng.integers(1, min(rows * cols, 3000) + 1))
    cell = rng.choice(rows * cols, n, replace=False)
    return rng, rows, cols, cell // cols, cell % cols, rng.integers(0, [2, 6, 1_000_001][seed % 3], n)


@pytest.mark.parametrize("seed", range(30))
def test_treap_search(seed):
    rng, rows, cols, row, col, value = grid(seed)
    tree = K2Treap.read(build(row, col, value))
    assert sorted(zip(row, col, value)) == sorted(zip(tree.row, tree.col, tree.value))
    whole = np.zeros((rows, cols), np.int64)
    whole[row, col] = value
    tie = rng.permutation(cols) if seed % 2 else np.arange(cols) // 3
    asked = [rng.choice(rows, int(rng.integers(1, min(rows, 40) + 1)), replace=False) for _ in range(7)]
    item = np.repeat(np.arange(7), [len(x) for x in asked])
    weight = rng.integers(1, 50, len(item))
    who, found, total = best_columns(tree, item, np.concatenate(asked), weight, tie, 5, wave=int(rng.integers(1, 40)))
    for i in range(7):
        sums = (whole[asked[i]] * weight[item == i][:, None]).sum(0)
        want = sorted((-x, tie[j]) for j, x in enumerate(sums) if x > 0)[:5]
        assert sorted((-x, tie[j]) for j, x in zip(found[who == i], total[who == i])) == want
        assert all(sums[j] == x for j, x in zip(found[who == i], total[who == i]))


def test_cells_hold_maxima():
    """No node is above its parent, and every point is the maximum of one square."""
    _, _, _, row, col, value = grid(2)
    tree = K2Treap.read(build(row, col, value))
    count = np.array([bin(n).count("1") for n in tree.nibble])
    parent = np.repeat(np.arange(len(count)), count)
    assert len(parent) == len(row) - 1 and (tree.value[1:] <= tree.value[parent]).all()
    assert tree.child[0] == 1


def test_search_reads_few_entries(monkeypatch):
    """Best-first descent leaves most of a large grid alone: the waves end long before all ranges are halved."""
    rng = np.random.default_rng(4)
    n = 60_000
    col = np.repeat(np.arange(6000), 10)
    row = rng.integers(0, 4000, n)
    keep = np.unique(row * 6000 + col)
    row, col = keep // 6000, keep % 6000
    value = rng.integers(1, 1000, len(row))
    value[:40] = 900_000
    tree = K2Treap.read(build(row, col, value))
    calls = []
    real = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, *a: (calls.append(len(keys[0])), real(keys, *a))[1])
    best_columns(tree, np.zeros(2, np.int64), np.array([row[0], row[1]]), np.array([1, 1]), np.arange(6000), 1)
    assert sum(calls) < 1500


def brute(docs, items, k=10):
    texts = [(d, Counter(t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(x or ""))) for d, x in docs]
    full = [(d, c) for d, c in texts if c]
    n_docs, n_terms = len(full), sum(sum(c.values()) for _, c in full)
    df = Counter(t for _, c in full for t in c)
    out = []
    for item, text in set(items):
        asked = {t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")}
        scored = []
        for d, c in full:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in asked if t in c
            )
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def pairs(df, name):
    return [(r[name], r["text"]) for r in df.select(name, "text").collect()]


def test_query_on_the_given_table(spark, sf_dir, documents):
    got = QUERIES["op12_lexical_search"](spark, sf_dir)
    want = brute(pairs(documents, "doc_id"), pairs(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_small_blocks_and_passes(spark, documents, sf_dir, monkeypatch):
    import emberline.llm.lexical_search as ls

    monkeypatch.setattr(ls, "ITEMS", 7)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    index = build_index(documents.repartition(4), block_bytes=1 << 16)
    assert index.blocks.count() > 5
    got = search(index, items, k=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(pairs(documents, "doc_id"), pairs(items, "item_id"), 3)


def test_awkward(spark, awkward, empty):
    """Null ids and texts, repeated rows and equal scores; items without terms; nothing in an empty index."""
    items = spark.createDataFrame(
        [(1, "QUICK brown fox; Äpfel"), (1, "QUICK brown fox; Äpfel"), (1, "one two"), (2, None), (3, "?!"), (None, "w1 w2 lazy"), (4, "absent")],
        "item_id long, text string",
    ).withColumn("doc_id", F.lit(5)).withColumn("score", F.lit("x"))
    got = search(build_index(awkward), items)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(pairs(awkward, "doc_id"), pairs(items, "item_id"))
    assert search(build_index(empty), items).count() == 0
    assert search(build_index(awkward), items.limit(0)).count() == 0
    assert search(build_index(awkward), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_impacts_beyond_64_bits():
    tf, size = np.array([1, 3]), np.array([10**7, 40])
    n_docs, n_terms = 10**11, 3 * 10**13 + 7
    want = [10**9 * t // (1000 * t + 8 * (10 + 90 * s * n_docs // n_terms)) for t, s in zip(tf.tolist(), size.tolist())]
    assert impacts(tf, size, n_docs, n_terms).tolist() == want


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_patterned_words_have_their_own_hashes():
    """Words of two letters in patterns, which meet under a polynomial modulo 2**64."""
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [a, b, "a" * 5, "a" * 6, "ab", "ba", f"{a} {b}", ""]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for gap in (K.IS_SPACE, IS_GAP):
        terms, first = K.words(np.frombuffer(data, np.uint8), offsets, gap)
        assert first.tolist() == [0, 1, 2, 3, 4, 5, 6, 8, 8]
        assert len(set(terms[:6].tolist())) == 6 and terms[6:].tolist() == terms[:2].tolist()
