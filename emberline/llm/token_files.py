"""Token ids of documents in binary files with Elias-Fano coded boundaries.

Documents are dealt to ascending ranges of ids, encoded inside the tasks that
hold a range, and joined to blocks.  A block is one file: a header, the code of
the document boundaries, the code of the document ids, and the ids of all its
documents as one array of 16-bit (32-bit for a larger vocabulary) integers in
little-endian order.  No table of 64-bit offsets is kept: the boundaries take
some bits for each document, and a selection gives any of them.

Files are written by Spark's own writer and read by its binary reader, so any
store that Spark reaches will do.  A file's folder names its place and its
number of ids: where a block starts in the whole stream is known from the
listing, without opening a file.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.elias_fano import EliasFano
from emberline.llm.kernels import release
from emberline.llm.packing import PieceTokenizer

MAGIC = b"EMBTOK1\n"
_HEAD = struct.Struct("<8sBxxxxxxxQQQQ")  # magic, bytes of an id, documents, those without an id, ids, start of the ids
END_ID = 0
RANGE_BYTES = 1 << 25  # of text in a range of ids
BLOCK_TOKENS = 1 << 23  # of a file, unless one document has more
CACHE_BYTES = 160 << 20  # of text units a worker remembers
PART_CHARS = 1 << 14  # of units encoded in one call
MOST_MARKS = 10_000  # runs of marks a worker remembers
#: A word of Latin letters with the space before it, then marks: two pre-tokens at most. No apostrophe, which may join both.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([,.;:!?]*)").fullmatch
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The letters that byte-level vocabularies write bytes with.
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class LibraryTokenizer(PieceTokenizer):
    """Ids by the ``tokenizers`` library, each distinct unit encoded once.

    Plain words go to the library's model as the pre-tokens they are; its
    pre-tokenizer cuts all other units.  What is remembered is bounded in bytes: beyond that it starts anew after
    the texts at hand.
    """

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(str(path.rsplit(".", 1)[0]) + ".json")
        self.vocabulary = library.get_vocab_size(with_added_tokens=True)
        self.library = library.encode_batch_fast
        self.model = library.model
        self.model._resize_cache(0)  # each unit comes once
        self.marks: dict[str, list[int]] = {}
        self.coder = self._encode
        self.remembered = 0

    def _encode(self, text: str) -> list[int]:
        """Ids of a text, cut before line breaks that follow a word: each is a token of its own there."""
        out, lo = [], 0
        while lo < len(text):
            hi = text.find("\n", lo + PART_CHARS)
            while hi > 0 and text[hi - 1] in self.spaces:
                hi = text.find("\n", hi + 1)
            hi = len(text) if hi < 0 else hi
            out += self.library([text[lo:hi]], add_special_tokens=False)[0].ids
            lo = hi
        return out

    def _word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        if word.isascii():
            letters = word.replace(" ", "Ġ")
        else:
            letters = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for t in self.model.tokenize(letters)]

    def _coded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = list(map(PLAIN, units))
        plain = np.array([m is not None for m in found], bool)
        learned = len(self.known) - len(units)
        ids: list[int] = []
        ends = [0]
        for m in filter(None, found):
            word, marks = m.groups()
            k = self.known.get(word, learned) if marks else learned
            if k < learned:  # the word stood alone before
                at = self.lo[k]
                ids += self.ids[at : at + self.size[k]].tolist()
            else:
                ids += self._word(word)
            if marks:
                if marks not in self.marks:
                    if len(self.marks) >= MOST_MARKS:
                        self.marks.clear()
                    self.marks[marks] = self._word(marks)
                ids += self.marks[marks]
            ends.append(len(ids))
        lo, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        lo[plain], size[plain] = ends[:-1], np.diff(ends)
        flat = np.array(ids, np.uint16)
        if not plain.all():
            rest, at, n = super()._coded([u for u, m in zip(units, found) if m is None])
            lo[~plain], size[~plain] = at + len(flat), n
            flat = np.concatenate([flat, rest])
        return flat, lo, size

    def _clear(self) -> None:
        super()._clear()
        self.remembered = 0

    def _learn(self) -> None:
        self.remembered += sum(map(sys.getsizeof, self.known.new)) + 100 * len(self.known.new)
        before = self.used
        super()._learn()
        self.remembered += 2 * (self.used - before)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if self.remembered > CACHE_BYTES:
            self._clear()
        return super().encode_all(texts)


_tokenizers: dict[str, LibraryTokenizer] = {}


def tokenizer(path: str) -> LibraryTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = LibraryTokenizer(path)
    return _tokenizers[path]


# ---- one block -----------------------------------------------------------------


def write_block(doc_ids: list[int | None], ids: list[np.ndarray], width: int = 2) -> bytes:
    """A file's bytes: documents in order, those without an id first."""
    ends = np.cumsum([0, *map(len, ids)])
    without = sum(d is None for d in doc_ids)
    bounds = EliasFano.of(ends).to_bytes()
    names = EliasFano.of(np.array(doc_ids[without:], np.int64)).to_bytes()
    start = -(-(_HEAD.size + len(bounds) + len(names)) // 8) * 8
    head = _HEAD.pack(MAGIC, width, len(doc_ids), without, int(ends[-1]), start)
    body = np.concatenate(ids).astype(f"<u{width}").tobytes() if ids else b""
    return (head + bounds + names).ljust(start, b"\0") + body


@dataclass
class Block:
    """A file's content: documents by place, offsets by selection."""

    width: int
    n_docs: int
    without_id: int
    n_tokens: int
    bounds: EliasFano
    names: EliasFano
    ids: np.ndarray

    @classmethod
    def read(cls, data: bytes | memoryview) -> Block:
        """The writer ends a file with a line feed, which is not part of the block."""
        magic, width, n, without, total, start = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(data)
        bounds, used = EliasFano.from_bytes(view[_HEAD.size :])
        names, _ = EliasFano.from_bytes(view[_HEAD.size + used :], signed=True)
        return cls(width, n, without, total, bounds, names, np.frombuffer(data, f"<u{width}", total, start))

    def offsets(self, places: np.ndarray) -> np.ndarray:
        """Where documents start (place n_docs: where the last ends)."""
        return self.bounds.select(places).astype(np.int64)

    def doc_ids(self) -> list[int | None]:
        named = self.names.select(np.arange(self.names.n)).astype(np.int64).tolist()
        return [None] * self.without_id + named

    def document(self, place: int) -> np.ndarray:
        lo, hi = self.offsets(np.array([place, place + 1]))
        return self.ids[lo:hi]


# ---- Spark -----------------------------------------------------------------------


def _blocks(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, number = task.partitionId() if task else 0, 0
        coder = tokenizer(path)
        width = 2 if max(coder.vocabulary, end_id + 1) <= 1 << 16 else 4
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, names, ids, held
            data = write_block(names, ids, width)
            row = [part, number, len(names), held, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            number += 1
            names, ids, held = [], [], 0
            release()
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "block", "n_docs", "n_tokens", "data"]
            )

        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                rows = batch.slice(lo, 128)
                coded = coder.encode_all([t or "" for t in rows.column(1).to_pylist()])
                for d, t in zip(rows.column(0).to_pylist(), coded):
                    if held and held + len(t) + 1 > most:
                        yield flush()
                    names.append(d)
                    ids.append(np.append(t, t.dtype.type(end_id)))
                    held += len(t) + 1
        if names:
            yield flush()

    return run


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    range_bytes: int = RANGE_BYTES,
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Write all documents in ascending order of their ids to files below ``folder``.

    Every document is followed by ``end_id``; a null or empty text is that id
    alone.  Rows without an id come first; rows that share an id follow the
    length and a hash of their text, and repeated rows are all written.  A
    range is cut inside such a group too, so no group has to fit one task.  An
    empty table gives no file.  Other columns are ignored.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), text.alias("t"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    order = ["d", "size", "tie", "place"]
    keyed = rows.select(
        "d", "t", F.octet_length("t").alias("size"), F.xxhash64("t").alias("tie"),
        F.xxhash64(F.monotonically_increasing_id()).alias("place"),
    )
    ranged = keyed.repartitionByRange(max(1, -(-size // range_bytes)), *order).sortWithinPartitions(*order)
    files = ranged.select("d", "t").mapInArrow(
        _blocks(tokenizer_path, end_id, block_tokens), "part int, block int, n_docs long, n_tokens long, data binary"
    )
    # a binary value cast to a string keeps its bytes, and the text writer writes them as they are
    files.withColumn("data", F.col("data").cast("string")).write.partitionBy(
        "part", "block", "n_docs", "n_tokens"
    ).text(folder)


def file_places(spark: SparkSession, folder: str) -> DataFrame:
    """part, block, n_docs, n_tokens and first_token of every file: sums over the listing, no file is read.

    One small row a file, of at least BLOCK_TOKENS ids but for a range's last.
    """
    files = spark.read.format("binaryFile").load(folder)
    order = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long").alias("first_token")
    return files.select("part", "block", "n_docs", "n_tokens").select("*", first)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            part, number, data = (c[k] for c in batch.columns)
            block = Block.read(data.as_buffer())
            at = block.offsets(np.arange(block.n_docs + 1))
            crc = [zlib.crc32(block.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [block.doc_ids(), at[:-1], np.diff(at), crc]
            where = [pa.array(np.full(block.n_docs, x.as_py()), pa.int32()) for x in (part, number)]
            yield pa.RecordBatch.from_arrays(
                [*where, *(pa.array(c, pa.int64()) for c in columns)],
                names=["part", "block", "doc_id", "start", "n_tokens", "ids_crc32"],
            )
        release()


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32.

    A folder without files gives no rows.
    """
    schema = "part int, block int, doc_id long, start long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").load(folder)
    if "part" not in files.columns:
        return spark.createDataFrame([], schema).drop("part", "block")
    rows = files.select("part", "block", "content").mapInArrow(_documents, schema)
    places = file_places(spark, folder).select("part", "block", "first_token")
    return rows.join(places, ["part", "block"]).select(
        "doc_id", (F.col("start") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32"
    )
