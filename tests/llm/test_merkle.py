"""Merkle manifest against a plain construction of all trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from emberline.llm import merkle
from emberline.llm.queries import QUERIES, fold


def digest(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def field(v) -> bytes:
    return b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def path(levels, at):
    steps = []
    for level in levels[:-1]:
        first = at - at % 16
        run = level[first : first + 16]
        steps.append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
        at //= 16
    return steps


def brute(rows):
    """Sorted rows of op11 over dictionaries of documents."""

    def leaf(r, text):
        return digest(b"".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))

    sources = {}
    for r in rows:
        key = (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))
        sources.setdefault(r["source"], []).append((key, r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for n in names:
        sources[n].sort(key=lambda x: x[0])
        trees[n] = tree([k[2] for k, _ in sources[n]])
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for j, n in enumerate(names):
        for i, (key, r) in enumerate(sources[n]):
            steps = path(trees[n], i) + path(top, j)
            cur = key[2]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                cur = leaf(r, "".join(c.lower() if c.isascii() else c for c in r["text"]))
            for at, others in steps:
                cur = digest("".join([*others[:at], cur, *others[at:]]))
            proof = digest("".join("".join(o) for _, o in steps))
            out.append((r["doc_id"], key[2], trees[n][-1][0], top[-1][0], proof, cur, cur == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(docs, tmp):
    docs.write.parquet(f"{tmp}/documents.parquet")
    df = QUERIES["op11_merkle"](docs.sparkSession, str(tmp))
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_on_the_given_table(spark, sf_dir, documents):
    got = sorted((tuple(r) for r in QUERIES["op11_merkle"](spark, sf_dir).collect()), key=str)
    assert got == brute([r.asDict() for r in documents.collect()])
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_awkward(spark, awkward, empty, tmp_path):
    """Null ids, sources and texts, repeated rows, clashing names; an empty table has no rows."""
    assert run(awkward, tmp_path / "a") == brute([r.asDict() for r in awkward.collect()])
    assert run(empty, tmp_path / "b") == []
    assert merkle.build_manifest(empty).root is None


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_recomputed_levels(spark, stride):
    """A large source beside lone leaves and many small ones: runs of one node, trees of every height."""
    n = F.col("id")
    docs = spark.range(0, 7000, 1, 7).select(
        n.alias("doc_id"),
        F.when(n % 3 < 2, "big").when(n % 31 == 0, None).otherwise(F.concat(F.lit("é"), (n % 300).cast("string"))).alias("source"),
        F.lit("en").alias("lang"), n.alias("n_chars"), F.concat(F.lit("Text "), n.cast("string")).alias("text"),
    )
    docs = docs.union(docs.filter("doc_id = 7").withColumn("source", F.lit("lone")))
    manifest = merkle.build_manifest(docs, F.when(fold(5) == 0, merkle.lower_ascii(F.col("text"))), stride)
    # levels between the stored ones are not kept
    assert [f.count() for f in manifest.sources.levels][0] == 7001
    heights = {1: 5, 2: 3, 3: 3}
    assert len(manifest.sources.levels) == heights[stride]
    got = merkle.verify(manifest).collect()
    want = brute([r.asDict() for r in docs.collect()])
    assert sorted((r.doc_id, r.leaf, r.proof_sha256, r.folded_root, r.verified) for r in got) == sorted(
        (w[0], w[1], w[4], w[5], w[6]) for w in want
    )
    assert {manifest.root.hex()} == {w[3] for w in want}


def test_proofs_are_given_whole(spark, documents):
    manifest = merkle.build_manifest(documents)
    rows = merkle.document_proofs(manifest).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert merkle.fold(bytes(r.leaf), bytes(r.siblings), bytes(r.shape)) == manifest.root
        assert merkle.fold(bytes(32), bytes(r.siblings), bytes(r.shape)) != manifest.root
