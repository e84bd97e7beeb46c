"""Exact dedup, near dedup and removal of repeats, against brute force."""

import hashlib
import time

import numpy as np
import pytest
from parity import compare, duck

from emberline.llm import kernels as K
from emberline.llm.components import components
from emberline.llm.exact_dedup import exact_dedup, exact_groups
from emberline.llm.near_dedup import near_dedup, near_groups, superminhash
from emberline.llm.oracle import SQL
from emberline.llm.queries import QUERIES
from emberline.sources.staging import stage
from emberline.llm.suffix_dedup import SPAN, minimisers, pack_ids, remove_repeats, repeated, runs, suffix_order, unpack_ids


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), duck(sf_dir), SQL[name]) is None


def test_words_and_shingles():
    texts = ["A b\tC d e f", "", "x", "  a B c d e f ", "a a a a a a a", "é É Z"]
    w, first = K.words(*buffer(texts))
    assert np.diff(first).tolist() == [6, 0, 1, 6, 7, 3]
    assert (w[:6] == w[7:13]).all() and w[-3] != w[-2]
    s, at = K.shingles(*buffer(texts))
    assert np.diff(at).tolist() == [2, 0, 1, 2, 1, 1]
    assert set(s[:2]) == set(s[3:5])


def test_exact_awkward(awkward, empty):
    rows = exact_groups(awkward).collect()
    assert len(rows) == awkward.count()
    by = {(r.doc_id, r.text_sha256): r for r in rows}
    blank = hashlib.sha256(b"").hexdigest()
    assert by[3, blank].keep_id == 4 and by[3, blank].group_size == 3 and not by[3, blank].kept
    assert sum(r.kept for r in rows if r.doc_id == 2) == 2 and not any(r.kept for r in rows if r.doc_id == 1)
    kept = exact_dedup(awkward)
    assert kept.columns == awkward.columns
    got = kept.select("doc_id", "text", "_t", "_h").collect()
    assert len({r.text or "" for r in got}) == len(got) == len({r.text_sha256 for r in rows})
    assert {r._t for r in got} == {None} and {r._h for r in got} == {"x"}
    assert exact_groups(empty).count() == 0 == exact_dedup(empty).count()


def test_exact_hot_group(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 700)) as text").repartition(8)
    rows = exact_groups(docs).toPandas()
    hot = rows[rows.doc_id % 3 == 0]
    assert (hot.keep_id == 2997).all() and (hot.group_size == 1000).all() and hot.kept.sum() == 1
    assert rows.kept.sum() == rows.text_sha256.nunique()


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 2**63, 40).astype(np.uint64)])
    sig = superminhash(np.concatenate([a, b, a[:3]]), np.repeat([0, 1, 2], [400, 400, 3]), 3, 192)
    assert abs((sig[0] == sig[1]).mean() - 360 / 440) < 0.12
    assert np.isfinite(sig).all()
    alone = superminhash(b, np.zeros(400, int), 1, 192)
    assert (alone[0] == sig[1]).all()


def brute_components(texts, threshold=85):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("block", [512, 8])
def test_near_copies_of_copies(spark, block):
    """Chains and a large group whose members mostly miss the first pivot."""
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts = []
    for _ in range(3):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(40):
            w = list(base)
            for p in rng.integers(0, 120, rng.integers(0, 4)):
                w[p] = str(rng.choice(vocabulary))
            texts.append(" ".join(w))
            if rng.random() < 0.3:
                base = w
    ids = rng.permutation(len(texts)).tolist()
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    want = brute_components(zip(ids, texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(docs, block=block).collect()}
    assert got == want


def test_near_awkward(awkward, empty):
    rows = near_groups(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1 and by[2].n_shingles == 18
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[3].kept and by[5].kept
    assert by[11].component_id == 10 and by[10].n_shingles == 1
    kept = near_dedup(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} >= {None, 1, 3, 4, 7, 10}
    assert not {r.doc_id for r in kept.collect()} & {2, 11}
    assert near_groups(empty).count() == 0 == near_dedup(empty).count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (205, 201), (203, 205)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100}
    assert got[205] == got[203] == 201


@pytest.mark.parametrize("n,letters", [(1, 2), (300, 2), (900, 3), (400, 256)])
def test_suffix_order(n, letters):
    text = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    order, _ = suffix_order(text)
    raw = text.tobytes()
    got = [raw[i : i + SPAN] for i in order]
    assert sorted(order.tolist()) == list(range(n)) and got == sorted(got)


def test_minimiser_depends_on_the_string_only():
    rng = np.random.default_rng(0)
    core = rng.integers(97, 123, 80).astype(np.uint8)
    a = np.concatenate([rng.integers(97, 123, 33).astype(np.uint8), core])
    b = np.concatenate([core, rng.integers(97, 123, 20).astype(np.uint8)])
    assert (minimisers(a)[33:] == minimisers(b)[: len(core) - SPAN + 1]).all()


def brute_removal(rows):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - SPAN + 1):
            w = raw[k : k + SPAN]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - SPAN + 1):
            if first[raw[k : k + SPAN]] < d:
                gone[k : k + SPAN] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot_least", [2000, 5])
def test_repeats(spark, hot_least):
    """Shared passages, common lines, periodic texts and copies; with the hot path and without."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 9))))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passages = prose(12), [prose(30) for _ in range(4)]
    texts = []
    for i in range(60):
        parts = [prose(int(rng.integers(1, 40)))]
        if i % 3 == 0:
            parts += [line, prose(5)]
        if i % 7 == 0:
            parts += [str(rng.choice(passages)), prose(3), str(rng.choice(passages))]
        if i % 10 == 0:
            parts.append("ab" * int(rng.integers(10, 200)))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], texts[9][5:], "é" * 70, "é" * 60, "a" * 49, "a" * 50, "a" * 51, None, ""]
    ids = rng.permutation(len(texts)).tolist()
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in remove_repeats(docs, hot_least=hot_least).collect())
    assert got == brute_removal(rows)


def test_runs_stay_in_their_row():
    rng = np.random.default_rng(8)
    opening = "".join(map(chr, rng.integers(97, 123, 90)))
    texts = ["", "ten bytes.", *(opening + "".join(map(chr, rng.integers(97, 123, 40))) for _ in range(3))]
    key, row, start, end = runs(*buffer(texts), 4)
    for r, t in enumerate(texts):
        alone = runs(*buffer([t]), 4)
        mine = row == r
        assert all((a == b[mine]).all() for a, b in zip((alone[0], *alone[2:]), (key, start, end)))


def test_repeats_after_short_rows(spark):
    """A slice that starts with short rows: openings shared by the documents that follow them."""
    rng = np.random.default_rng(9)
    draw = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    opening = draw(70)
    rows = list(enumerate(["", "ten bytes.", *(opening + draw(60) for _ in range(6))]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in remove_repeats(docs).collect()) == brute_removal(rows)


def test_repeats_of_the_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in remove_repeats(documents).collect()) == brute_removal(rows)


def test_repeats_in_passes(spark, documents, monkeypatch):
    """Runs that take more disk than the texts are exchanged in several passes, each of which gives its disk back."""
    import emberline.llm.suffix_dedup as S

    assert S._passes(0, 0) == S._passes(10, 10 * S.RUN_BYTES) == 1 and S._passes(11, 10 * S.RUN_BYTES) == 2
    want = sorted(tuple(r) for r in remove_repeats(documents).collect())
    staged, disk = [], spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {name for name in (found.apply(k).getName() for k in range(found.size())) if name.startswith("shuffle_")}

    def keep(df, name):
        if name == "strings" and not before:
            before.append(files())
        staged.append((name, stage(df, name)))
        return staged[-1][1]

    before = []
    monkeypatch.setattr(S, "stage", keep)
    monkeypatch.setattr(S, "_passes", lambda n_runs, n_bytes: 3 if 0 < n_runs < n_bytes else 0)
    rows = remove_repeats(documents)
    for _ in range(50):  # files are deleted in the background
        if not files() - before[0]:
            break
        time.sleep(0.2)
    assert not files() - before[0]
    parts = [df.count() for name, df in staged if name == "strings"]
    assert len(parts) == 3 and all(parts)
    assert sorted(tuple(r) for r in rows.collect()) == want


def test_repeats_awkward(awkward, empty):
    rows = remove_repeats(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.n_removed == 0 for r in rows if r.doc_id in (None, 1))
    assert all(r.n_removed == r.n_bytes and r.n_spans == 1 for r in rows if r.doc_id == 2)
    assert [r.n_bytes for r in rows if r.doc_id == 3] == [0]
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("ids", [[5], [7, 3, 9], [-5, 2**40], [-(2**63), 2**63 - 1, 0]])
def test_packed_ids(ids):
    assert unpack_ids(pack_ids(np.array(ids))).tolist() == ids


def test_a_buffer_beyond_two_million_ranks():
    """10 MB of random bytes with passages planted at known places: every string is found, and no other."""
    rng = np.random.default_rng(11)
    parts = [rng.integers(0, 256, 1_000_000).astype(np.uint8) for _ in range(10)]
    want = set()
    for j in range(1, 10):
        for k in range(40):
            source, at, to = int(rng.integers(0, j)), int(rng.integers(0, 900_000)), 20_000 * k + 10_000
            size = int(rng.integers(SPAN, 300))
            parts[j][to : to + size] = parts[source][at : at + size]
            want |= {(j, to + x) for x in range(size - SPAN + 1)}
    of, place = repeated([p.tobytes() for p in parts], np.arange(10))
    got = set(zip(of.tolist(), place.tolist()))
    assert want <= got
    # a copied passage may run on by chance; nothing else is found
    assert all((j, x - 1) in want or (j, x + 1) in want for j, x in got - want)


def test_one_long_periodic_text(spark):
    rows = [(1, "abcdefg" * 60_000), (2, "x" + "bcdefga" * 40), (3, "nothing of that kind " * 2), (4, "q" * 300_000), (5, "q" * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(docs).collect()}
    assert got == {1: (420_000, 0, 0), 2: (281, 280, 1), 3: (42, 0, 0), 4: (300_000, 0, 0), 5: (120, 120, 1)}
