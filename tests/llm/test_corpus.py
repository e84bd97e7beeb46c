"""Mixing, packing, neighbours, URL filter and the pipeline."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_dedup import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from emberline.llm.mixing import MARGINS, mixture, rake, sample_mixture
from emberline.llm.neighbours import nearest
from emberline.llm.packing import PieceTokenizer, pack, pack_lengths
from emberline.llm.queries import QUERIES
from emberline.llm.url_filter import host_edges, judge

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pieces():
    return PieceTokenizer(PATH)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\x1c\x85\u3000'sab1!*"))))
def test_same_ids(pieces, reference, text):
    assert pieces.encode(text).tolist() == reference(text)


@pytest.fixture(scope="module")
def default():
    """The JSON file's tokenizer in its default state, which gives added tokens their own ids."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "a", "it's", " b  ", "é1", "<|", "|>"]), max_size=9))
def test_same_ids_with_added_tokens(pieces, default, parts):
    text = "".join(parts)
    assert pieces.encode(text).tolist() == default(text)


def test_packing_added_token(spark, default):
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|>", 3: None, 4: "plain"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pack(docs, PATH).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {1: 5, 2: 2, 3: 1, 4: len(default("plain")) + 1}
    check_pieces(rows, texts, default)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_packing_round_trip(lengths):
    packed = pack_lengths(lengths)
    seen = defaultdict(list)
    for sequence in packed:
        size = sum(n for _, _, n in sequence)
        assert 0 < size <= 2048 and (size == 2048 or size & (size - 1) == 0)
        for d, at, n in sequence:
            seen[d].append((at, n))
    for d, n in enumerate(lengths):
        end = 0
        for at, k in sorted(seen[d]):
            assert at == end and k > 0
            end += k
        assert end == n


def check_pieces(rows, texts, reference):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = np.array([*reference(text or ""), 1], np.uint32)
        end = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == end and r.doc_tokens == len(ids)
            end += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : end].astype("<u4").tobytes())
        assert end == len(ids)
    padding = total = 0
    for rows in by_sequence.values():
        end = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
        total += end
        padding += 2048 - end if end & (end - 1) else 0
    assert padding <= 0.01 * total


def test_packing_of_the_table(spark, sf_dir, documents, reference):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    check_pieces(QUERIES["op2_packing"](spark, sf_dir).collect(), texts, reference)
    check_pieces(pack(documents.repartition(4), PATH, group_tokens=5000).collect(), texts, reference)


def test_packing_awkward(awkward, empty, reference):
    unique = awkward.filter("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    check_pieces(pack(unique, PATH).collect(), {r.doc_id: r.text for r in unique.collect()}, reference)
    rows = pack(awkward, PATH).collect()
    assert sum(r.start == 0 for r in rows) == awkward.count()
    assert pack(empty, PATH).count() == 0


def test_raking_meets_all_targets(spark):
    rng = np.random.default_rng(0)
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(1, 1000))) for i in range(5) for j in range(3) for k in range(2)]
    df = spark.createDataFrame(cells, "_source string, _lang string, _topic string, tokens long")
    want = {
        "_source": {f"s{i}": v for i, v in enumerate([0.4, 0.3, 0.1, 0.1, 0.1])},
        "_lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}, "_topic": {"t0": 0.35, "t1": 0.65},
    }
    targets = {m: spark.createDataFrame(list(t.items()), f"{m} string, target double") for m, t in want.items()}
    got = rake(df, targets, 8).collect()
    for m in MARGINS:
        for value, share in want[m].items():
            assert sum(r.weight for r in got if r[m] == value) == pytest.approx(share, abs=1e-4)
    # brute force: the same steps on a cube
    cube = np.array([c[3] for c in cells], float).reshape(5, 3, 2)
    cube /= cube.sum()
    for _ in range(8):
        for axis, m in enumerate(MARGINS):
            t = np.array(list(want[m].values()))
            others = tuple(a for a in range(3) if a != axis)
            cube *= (t / cube.sum(axis=others)).reshape([-1 if a == axis else 1 for a in range(3)])
    weight = {(r["_source"], r["_lang"], r["_topic"]): r.weight for r in got}
    assert [weight[c[:3]] for c in cells] == pytest.approx(cube.reshape(-1).tolist())


def test_mixture_draws_what_it_should(documents):
    rows = mixture(documents).collect()
    assert len(rows) == documents.count()
    total = sum(r._tokens for r in rows)
    assert sum(r._tokens * r._probability for r in rows) == pytest.approx(0.5 * total, rel=1e-6)
    assert abs(sum(r._tokens for r in rows if r._kept) / total - 0.5) < 0.15
    assert all(r._kept == (r._u < r._probability) and 0 <= r._probability <= 1 for r in rows)
    one = mixture(documents, lang_targets={"en": 1.0}, budget=0.1).collect()
    assert {r["_row"].lang for r in one if r._kept} == {"en"}


def test_mixing_awkward(awkward, empty):
    rows = mixture(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r._probability == 0 for r in rows if r["_row"].text is None or not r["_row"].text.split())
    kept = sample_mixture(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r._kept for r in rows)
    assert mixture(empty).count() == 0 == sample_mixture(empty).count()


def brute_nearest(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in rows if j != i)[:k]
            out[i] = d
    return out


def test_neighbours_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in table.collect()], 10)
    got = defaultdict(list)
    for r in QUERIES["op3_neighbours"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    assert set(got) == set(want)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_in_shards(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x[500:900] = x[500]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = brute_nearest(rows, 10)
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 100 == 0, shard=700, block=7, enough=2500).orderBy("rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [j for _, j in got[600]] == [500, *range(501, 510)] and {s for s, _ in got[600]} == {0.0}


@pytest.mark.parametrize("shard", [8192, 20])
def test_neighbours_repeated_rows(spark, shard):
    x = np.random.default_rng(11).normal(size=(30, 8))
    x[7] = x[3]
    rows = [(50 * i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows * 3, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 100 == 0, shard=shard).orderBy("query_id", "rank").collect():
        got[r.query_id].append((pytest.approx(r.score), r.vec_id))
    assert {q: list(map(tuple, v)) for q, v in got.items()} == brute_nearest(rows, 10)


def test_neighbours_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1),
        (6, [1.0, inf], 1), (7, [None, 1.0], 1), (8, [], 1), (None, [1.0, 1.0], 1), (100, [3.0, 0.0], 1), (100, [3.0, 0.0], 1),
        (9, [1.0, 2.0, 3.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [
        (0, 1, 1, 0.0), (0, 2, 2, pytest.approx(2**0.5)), (0, 3, 100, 2.0),
        (100, 1, 0, 2.0), (100, 2, 1, 2.0), (100, 3, 2, pytest.approx(10**0.5)),
    ]
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_url_rules(spark):
    urls = {
        "http://a.example.net/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "HTTP://B.NET/q?x#y": ("b.net", "/q", "net/", "block"),
        "https://c.net": ("c.net", "", None, "allow"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "https://x.org/fr/1?u=http://y.net/": ("x.org", "/fr/1", "org/fr/", "allow"),
        "x.org/fr/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a://b?c://d/net/": ("b", "", None, "allow"),
        "://": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, None, "h") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    assert judge(df.limit(0)).count() == 0


def test_links_spread_distrust(spark):
    """Against a power iteration in numpy."""
    links = [("s.com", "bad.net"), ("s.com", "bad.net"), ("s.com", "t.com"), ("u.com", "s.com"), ("ok.org", "t.com"),
             ("ok.org", "u.com"), ("t.com", "ok.org"), ("farm.com", "bad.net"), ("bad.net", "s.com")]
    pages = [(i, f"https://{a}/fr/{i}", f'<p><a class="x" href="https://{b}/p">y</a><a href="/own">z</a>') for i, (a, b) in enumerate(links)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    hosts = sorted({h for e in links for h in e})
    m = np.zeros((len(hosts), len(hosts)))
    for a, b in links:
        m[hosts.index(a), hosts.index(b)] += 1
    assert host_edges(df.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))).agg(F.sum("n")).first()[0] == len(links)

    def walk(matrix, seed):
        out = matrix.sum(axis=1, keepdims=True)
        step = np.divide(matrix, out, out=np.zeros_like(matrix), where=out > 0)
        mass = 0.15 * seed
        for _ in range(10):
            mass = 0.15 * seed + 0.85 * mass @ step
        return mass

    trust = walk(m, np.array([float(h.endswith(".org")) for h in hosts]))
    distrust = walk(m.T, np.array([float(h.endswith(".net")) for h in hosts]))
    threshold = 0.02 / 0.15
    got = {r.host: r for r in judge(df, threshold=threshold).collect()}
    for h, r in got.items():
        assert (r.trust, r.distrust) == (pytest.approx(trust[hosts.index(h)]), pytest.approx(distrust[hosts.index(h)]))
        if r.rule is None:
            assert r.verdict == ("block" if r.distrust > max(threshold * 0.15, r.trust) else "allow")
    assert {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"} and got["ok.org"].rule == "org/fr/"


def test_pipeline(spark, sf_dir, documents, reference):
    from emberline.llm.language_id import identify
    from emberline.llm.near_dedup import near_groups
    from emberline.llm.queries import fold

    docs, seen = documents, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, sf_dir).cache()
        assert after.columns == documents.columns
        seen.append((docs, after))
        docs = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen[0]
    good = identify(before, fold(4) != 2).filter("lang_pred <> 'und' and score >= 0.3")
    assert ids(after) == ids(good)
    before, after = seen[1]
    last = {r.text: r.doc_id for r in before.orderBy("doc_id").collect()}
    assert ids(after) == set(last.values())
    before, after = seen[2]
    assert ids(after) == ids(near_groups(before, threshold=80, per_band=5).filter("kept"))
    before, after = seen[3]
    assert ids(after) == {r["_row"].doc_id for r in mixture(before).filter("_kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), texts, reference)
    check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), texts, reference)


def test_pipeline_near_copies(spark):
    """The stage against brute force at 0.8, with pairs on both sides of it."""
    rng = np.random.default_rng(12)
    vocabulary = [f"v{i}" for i in range(9000)]
    texts, between = [], 0
    for cut in (5, 8, 10, 11, 12, 13, 14, 16, 20) * 3:
        base = list(rng.choice(vocabulary, 104))
        copy = [*base[:-cut], *rng.choice(vocabulary, cut)]
        texts += [" ".join(base), " ".join(copy)]
        between += 0.8 <= (100 - cut) / (100 + cut) < 0.85
    assert between
    want = {d for d, (_, c) in brute_components(enumerate(texts), 80).items() if d == c}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == want
    assert len(want) < len({d for d, (_, c) in brute_components(enumerate(texts), 85).items() if d == c})


def test_pipeline_awkward(spark, awkward, empty, sf_dir):
    for docs in (awkward, empty):
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, sf_dir)
        docs.count()


def test_language_stage_without_labels(spark, documents):
    """Nothing is labelled: all rows stay."""
    from emberline.llm.language_id import keep_known

    docs = documents.withColumn("lang", F.lit(None).cast("string"))
    assert keep_known(docs, F.lit(True)).count() == documents.count()


def test_found_language_goes_on(spark, documents):
    from emberline.llm.language_id import identify, keep_known
    from emberline.llm.queries import fold

    blank = documents.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    after = {r.doc_id: r.lang for r in keep_known(blank, fold(4) != 2, found_col="lang").collect()}
    found = {r.doc_id: r.lang_pred for r in identify(blank, fold(4) != 2).collect()}
    assert after and all(found[d] == lang for d, lang in after.items())


def test_dotted_names(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "`doc.id` long, `the.text` string")
    assert {r.doc_id for r in pack(docs, PATH, id_col="doc.id", text_col="the.text").collect()} == {1, 2}
