"""Elias-Fano codes and token files: exact round trips and whole results against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberline.llm.elias_fano import EliasFano, pack_bits, unpack_bits
from emberline.llm.queries import QUERIES
from emberline.llm.token_files import Block, LibraryTokenizer, read_documents, write_block, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1)), st.sampled_from([1, 50, 1 << 40, 1 << 63]))
def test_elias_fano(values, within):
    values = np.sort(np.array([v % within if within < 1 << 63 else v for v in values], np.int64))
    code, used = EliasFano.from_bytes(EliasFano.of(values).to_bytes() + b"more", signed=True)
    assert used == len(EliasFano.of(values).to_bytes())
    assert code.select(np.arange(len(values))).astype(np.int64).tolist() == values.tolist()


def test_elias_fano_is_small_and_selects_anywhere():
    rng = np.random.default_rng(5)
    for values in (np.cumsum(rng.integers(0, 900, 50_000)), np.repeat(np.arange(40) * 10**12, 1000)):
        code = EliasFano.of(values)
        at = rng.integers(0, len(values), 3000)
        assert code.select(at).astype(np.int64).tolist() == values[at].tolist()
        limit = len(values) * (2 + np.log2(max(1, values[-1] / len(values))) + 32 / 256 + 0.5) / 8 + 100
        assert len(code.to_bytes()) < limit
    with pytest.raises(IndexError):
        code.select(np.array([len(values)]))


@pytest.mark.parametrize("width", [0, 1, 5, 8, 17, 33, 63])
def test_packed_bits(width):
    values = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint64) if width else np.zeros(1001, np.uint64)
    assert unpack_bits(pack_bits(values, width), 1001, width).tolist() == values.tolist()


def test_block():
    ids = [np.array([5, 0], np.uint16), np.array([0], np.uint16), np.array([1, 2, 3, 0], np.uint16)]
    block = Block.read(write_block([None, -4, 1 << 60], ids) + b"\n")
    assert block.doc_ids() == [None, -4, 1 << 60]
    assert [block.document(k).tolist() for k in range(3)] == [x.tolist() for x in ids]
    with pytest.raises(ValueError):
        Block.read(b"x" * 80)


def expected(docs, encode):
    """Rows in the order of the files."""
    out, at = [], 0
    for doc_id, text in docs:
        ids = [*encode(text), 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_on_the_given_table(spark, sf_dir, documents, encode):
    got = [tuple(r) for r in QUERIES["op13_token_files"](spark, sf_dir).orderBy("doc_id").collect()]
    assert got == expected([(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()], encode)


def test_many_blocks(spark, documents, encode, tmp_path):
    """Small ranges and blocks: the places of the files add up, and the ids are there as they stand."""
    folder = str(tmp_path / "files")
    write_token_files(documents.repartition(5), folder, PATH, range_bytes=1 << 16, block_tokens=2000)
    got = [tuple(r) for r in read_documents(spark, folder).orderBy("doc_id").collect()]
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    assert got == expected(rows, encode)
    files = spark.read.format("binaryFile").load(folder).orderBy("part", "block").collect()
    assert len(files) > 50
    stream = np.concatenate([Block.read(bytes(f.content)).ids for f in files]).tolist()
    assert stream == [i for _, t in rows for i in [*encode(t), 0]]


def test_awkward(spark, awkward, empty, encode, tmp_path):
    """Null ids come first, rows of one id by length of text; every row is written; no file for an empty table."""
    write_token_files(awkward, str(tmp_path / "a"), PATH, block_tokens=64)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_documents(spark, str(tmp_path / "a")).collect())
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, len((r[1] or "").encode()), r[1] or ""))
    assert got == [(s, d, n, c) for d, s, n, c in expected(rows, encode)]
    write_token_files(empty, str(tmp_path / "b"), PATH)
    assert read_documents(spark, str(tmp_path / "b")).count() == 0


def test_repeated_id_is_spread(spark, encode, tmp_path):
    docs = spark.createDataFrame([(7, "same text " * 30)] * 400 + [(8, "b")], "doc_id long, text string").repartition(4)
    write_token_files(docs, str(tmp_path / "f"), PATH, range_bytes=1 << 13)
    got = read_documents(spark, str(tmp_path / "f"))
    assert [tuple(r) for r in got.orderBy("start").collect()] == expected([(7, "same text " * 30)] * 400 + [(8, "b")], encode)
    assert got.select("doc_id").filter("doc_id = 7").count() == 400
    assert spark.read.format("binaryFile").load(str(tmp_path / "f")).select("part").distinct().count() > 5


@pytest.mark.parametrize("text", ["x" * 5000, "日本語" * 900 + " a b", "a <|endoftext|> b" + "ab" * 400, "", " \n\n  " * 100, "a" + "\n" * 20_000 + "b\n c"])
def test_long_units(encode, text):
    coder = LibraryTokenizer(PATH)
    assert coder.encode_all([text, "a b", text])[2].tolist() == encode(text)


def test_memory_of_units_is_bounded_in_bytes(encode, monkeypatch):
    """Kilobyte units fill it after a few texts, and ids stay right when it starts anew."""
    import emberline.llm.token_files as tf

    monkeypatch.setattr(tf, "CACHE_BYTES", 200_000)
    coder = LibraryTokenizer(PATH)
    for i in range(60):
        text = f"{i}" + "語x" * 2000 + f" word{i}"
        assert coder.encode_all([text])[0].tolist() == encode(text)
        assert coder.remembered < 240_000


@pytest.fixture(scope="module")
def coder():
    return LibraryTokenizer(PATH)


WORD_TEXTS = st.lists(
    st.sampled_from(["don't", "it's,", "Äpfel,", " ", "\n", "a", "ẞ", "ıİ", "ªº", "×÷", "ƻǀ", "x9", "9.", "...", "!?", "'s", "́a", "naïve;", "œuvre", "日本"])
    | st.text("abÀÿɏɐ .,'´\n", max_size=8), max_size=30,
).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(WORD_TEXTS, min_size=1, max_size=4))
def test_plain_words_are_the_pre_tokens_they_seem(encode, coder, texts):
    coder._clear()
    for t in (texts, texts[::-1]):
        assert [x.tolist() for x in coder.encode_all(t)] == [encode(x) for x in t]


def test_plain_words_need_no_pre_tokenizer(encode):
    coder = LibraryTokenizer(PATH)
    coder.library = None
    text = "Plain words, größer déjà; again words... End."
    assert coder.encode_all([text])[0].tolist() == encode(text)
