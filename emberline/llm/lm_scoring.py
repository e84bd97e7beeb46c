"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are gathered over all training texts.  A count c
is kept as its level, about twice the binary logarithm: the filter holds the
n-gram once for each level up to its own, and a reader probes level after level
until one is missing.  The filter's bits follow the n-grams and it is cut into
parts by their hash.  Up to MAX_BITS it is broadcast; a larger one stays in its
parts and the distinct n-grams of blocks of text are sent there and come back
with their levels.  Both ways read the same bits, once: the levels of all tokens
are written, two bytes a token, and the shares are fitted and the scores made
from them.

A pair's probability mixes its relative frequency with that of the word; the
share of the pair depends on the level of the first word and is fitted with the
text's own occurrence taken out.

The base score needs exact word counts.  Those of the most frequent words, a
table of bounded size, are broadcast; the rest are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm import kernels as K
from emberline.sources.staging import shuffles_freed, stage

MAX_BITS = 1 << 28  # of a filter that is broadcast: 32 MB
BLOCK_BYTES = 4 << 20  # of text whose n-grams are asked for together
PER_ITEM = 8  # bits of the filter for each n-gram and level, at least
PROBES = 4
HEAD_WORDS = 1 << 18  # words whose exact counts are broadcast, at most
FLUSH_WORDS = 1 << 20  # held by a task before it sends its counts
LEVELS = 96
#: Smallest count of each level, at steps of the square root of 2.
LOWER = np.ceil(2 ** (np.arange(LEVELS) / 2) - 1e-9)
#: The count a level stands for: the middle of its range.
VALUE = np.append(0, (LOWER + np.append(LOWER[1:], LOWER[-1] * 2) - 1) / 2)
END = K.mix(np.array([0xE4D], np.uint64))[0]
BEGIN = K.mix(np.array([0xB36], np.uint64))[0]
FIRST = LEVELS + 1  # in place of a level: BEGIN, which stands as often as there are texts
ASKED_KEYS = 1 << 20  # looked up together
_PAIR = np.uint64(0xA0761D6478BD642F)
_WORD = np.uint64(0xE7037ED1A0B428DB)


def level(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOWER, count, "right")


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, previous word, row offsets) of all tokens, each row closed by END."""
    w, first = K.words(data, offsets)
    rows = np.arange(len(offsets) - 1)
    out = np.full(len(w) + len(rows), END)
    out[np.arange(len(w)) + np.repeat(rows, np.diff(first))] = w
    at = first + np.arange(len(offsets))
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[at[:-1]] = BEGIN
    return out, before, at


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return K.mix(before * _PAIR + word)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


COUNTED = "part int, kind int, keys binary, counts binary"


def _pack(part: int, kind: int, key: np.ndarray, n: np.ndarray) -> tuple:
    """Keys of pairs lose 16 bits; those of words stay whole."""
    raw = key.astype("<u8").view(np.uint8).reshape(-1, 8)
    return part, kind, np.ascontiguousarray(raw[:, :8 if kind == 0 else 6]).tobytes(), n.astype(np.uint32).tobytes()


def _unpack(kind: int, raw: bytes) -> np.ndarray:
    width = 8 if kind == 0 else 6
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _place(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, key within the part) of a hash: upper bits, and the 48 below them."""
    return (key >> np.uint64(64 - bits)).astype(np.int64), (key << np.uint64(bits)) >> np.uint64(16)


def _count_batches(bits: int):
    parts = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            rows = []
            for kind in (0, 1):
                key, n = np.unique(np.concatenate([h[kind] for h in held]), return_counts=True)
                part, low = _place(key, bits)
                cut = np.searchsorted(part, np.arange(parts + 1))
                for p in range(parts):
                    s, e = cut[p], cut[p + 1]
                    if e > s:
                        rows.append(_pack(p, kind, key[s:e] if kind == 0 else low[s:e], n[s:e]))
            held, size = [], 0
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "kind", "keys", "counts"]
            )

        for batch in batches:
            data, offsets = K.utf8(batch.column(0))
            for lo, hi in K.slices(offsets):
                at = offsets[lo : hi + 1]
                word, before, _ = tokens(data[at[0] : at[-1]], at - at[0])
                held.append((word, pair_key(before, word)))
                size += len(word)
                if size >= FLUSH_WORDS:
                    yield flush()
        if held:
            yield flush()

    return run


def _merge_counts(table: pa.Table) -> pa.Table:
    """One row per part and kind, with its level histogram: numbers of n-grams and their counts."""
    rows = table.to_pylist()
    part = rows[0]["part"]
    out = []
    for kind in (0, 1):
        mine = [r for r in rows if r["kind"] == kind]
        if mine:
            key, n = _merged(
                [_unpack(kind, r["keys"]) for r in mine],
                [np.frombuffer(r["counts"], np.uint32).astype(np.int64) for r in mine],
            )
            lv = level(n)
            grams = np.bincount(lv, minlength=LEVELS + 1)
            total = np.bincount(lv, weights=n, minlength=LEVELS + 1).astype(np.int64)
            out.append((*_pack(part, kind, key, np.minimum(n, 2**32 - 1)), grams.tolist(), total.tolist()))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["part", "kind", "keys", "counts", "grams", "total"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _positions(low: np.ndarray, lv: np.ndarray | int, size: int) -> Iterator[np.ndarray]:
    h = K.mix(low * K.GOLDEN + np.asarray(lv, np.uint64) * _PAIR)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


def _segment_batches(bits: int, size: int):
    """The part of the filter that holds the n-grams of a part."""

    def packed(part: int, segment: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([np.packbits(segment, bitorder="little").tobytes()])],
            names=["part", "segment"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, segment = -1, np.zeros(size, bool)  # both kinds of a part stand together
        for batch in batches:
            for part, kind, keys, counts in zip(*(batch.column(k).to_pylist() for k in ("part", "kind", "keys", "counts"))):
                n = np.frombuffer(counts, np.uint32)
                low = _unpack(kind, keys)
                if kind == 0:
                    low = _place(low, bits)[1] ^ (_WORD >> np.uint64(16))
                lv = level(n)
                if part != last:
                    if last >= 0:
                        yield packed(last, segment)
                    last, segment = part, np.zeros(size, bool)
                for q in range(1, int(lv.max()) + 1 if len(lv) else 0):
                    low, lv = low[lv >= q], lv[lv >= q]
                    for p in _positions(low, q, size):
                        segment[p] = True
        if last >= 0:
            yield packed(last, segment)

    return run


@dataclass
class Filter:
    bits: int  # of the part number
    size: int  # bits of a part
    data: np.ndarray  # (parts, size / 8)

    def levels(self, key: np.ndarray, kind: int) -> np.ndarray:
        """Level of each n-gram: probes go on while all bits are set."""
        part, low = _place(key, self.bits)
        return self.levels_at(part, low, kind)

    def levels_at(self, part: np.ndarray, low: np.ndarray, kind: int) -> np.ndarray:
        """As ``levels``, for keys whose place is known."""
        if kind == 0:
            low = low ^ (_WORD >> np.uint64(16))
        out = np.zeros(len(low), np.int64)
        alive = np.arange(len(low))
        for q in range(1, LEVELS + 1):
            if len(alive) == 0:
                break
            ok = np.ones(len(alive), bool)
            for p in _positions(low, q, self.size):
                ok &= (self.data[part, p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
            alive, low, part = alive[ok], low[ok], part[ok]
            out[alive] = q
        return out


Looked = tuple[np.ndarray, np.ndarray]


@dataclass
class Model:
    filter: Filter | None  # None if it stays in its parts
    n: int  # training tokens
    v: int  # distinct ones
    docs: int
    share: np.ndarray  # of the pair, by level of the first word
    head: np.ndarray  # sorted hashes of frequent words
    head_count: np.ndarray

    def parts(self, before: np.ndarray, word: np.ndarray, pair: np.ndarray, left_out: int = 0):
        """(level of the first word, pair frequency, word frequency) of levels; ``left_out`` is taken from each count."""
        value = np.append(VALUE, self.docs)
        of = np.maximum(value[before] - left_out, 0)
        both = np.maximum(VALUE[pair] - left_out, 0)
        frequency = np.where(of > 0, np.minimum(1, both / np.maximum(of, 1)), 0)
        single = (np.maximum(value[word] - left_out, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))
        return np.where(before == FIRST, level(np.array([self.docs])), before), frequency, single


LEVELLED = (
    "_row long, doc_id long, known boolean, n_tokens long, base double, n_known long, tail array<long>,"
    " words binary, pairs binary"
)


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Bytes of each row; ``offsets`` are those of the rows."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.astype(np.uint8))]
    )


def _levelled(model: Model, row: pa.Array, ids: pa.Array, known: pa.Array, text: tuple, looked: Looked | None) -> dict:
    """Columns of LEVELLED for rows whose ``text`` is (word, previous word, row offsets).

    ``looked``: levels of the distinct words and pairs, in their order, if they were looked up.
    """
    word, before, first = text
    u, back = np.unique(word, return_inverse=True)
    pair, again = np.unique(pair_key(before, word), return_inverse=True)
    lv, pair_lv = looked or (model.filter.levels(u, 0), model.filter.levels(pair, 1))
    scale = np.log10(model.n + 0.5 * (model.v + 1))
    inside, part = np.zeros(len(u), bool), np.zeros(len(u))
    if len(model.head):
        k = np.minimum(np.searchsorted(model.head, u), len(model.head) - 1)
        inside = model.head[k] == u
        part = np.where(inside, np.log10(model.head_count[k] + 0.5) - scale, 0.0)
    inside, outside = inside[back], np.zeros(len(word) + 1, np.int64)
    np.cumsum(~inside, out=outside[1:])
    tail = pa.ListArray.from_arrays(pa.array(outside[first].astype(np.int32)), pa.array(word[~inside].view(np.int64)))
    return {
        "_row": row, "doc_id": ids, "known": known, "n_tokens": pa.array(np.diff(first)),
        "base": pa.array(K.sums(part[back], first)), "n_known": pa.array(K.sums(inside.astype(np.int64), first)),
        "tail": tail, "words": _binary(np.where(u == BEGIN, FIRST, lv)[back], first), "pairs": _binary(pair_lv[again], first),
    }


def _level_batches(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 40
        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            for lo, hi in K.slices(offsets):
                at = offsets[lo : hi + 1]
                text = tokens(data[at[0] : at[-1]], at - at[0])
                n = hi - lo
                ids, known = (batch.column(k).slice(lo, n) for k in (0, 2))
                yield pa.RecordBatch.from_pydict(_levelled(model, pa.array(np.arange(row, row + n)), ids, known, text, None))
                row += n

    return run


def _token_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple]]:
    """Rows of a batch, their offsets, and the levels of their tokens: (previous word, word, pair)."""
    for batch in batches:
        (word, offsets), (pair, _) = (K.utf8(batch.column(k)) for k in ("words", "pairs"))
        for lo, hi in K.slices(offsets):
            at = offsets[lo : hi + 1]
            w, p = (x[at[0] : at[-1]].astype(np.int64) for x in (word, pair))
            before = np.empty_like(w)
            before[1:] = w[:-1]
            before[at[:-1] - at[0]] = FIRST
            yield batch.slice(lo, hi - lo), at - at[0], (before, w, p)


CELLS = "key long, n long"


def _share_batches(model: Model):
    """Numbers of tokens by level of the first word and ratio of the two frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, (before, word, pair) in _token_levels(batches):
            key, n = np.unique((before << 14) + (word << 7) + pair, return_counts=True)
            lv, both, single = model.parts(key >> 14, key >> 7 & 127, key & 127, 1)
            ratio = np.clip(np.round(4 * np.log2(np.maximum(both, 1e-12) / single)), -120, 120).astype(np.int64)
            ratio[both == 0] = -128
            cell, back = np.unique(lv * 512 + ratio + 128, return_inverse=True)
            total = np.bincount(back, weights=n, minlength=len(cell)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"key": pa.array(cell), "n": pa.array(total)})

    return run


def _fit_shares(rows) -> np.ndarray:
    """Share of the pair by level, by expectation maximisation on ratios of the two frequencies."""
    share = np.zeros(LEVELS + 1)
    by: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        by.setdefault(r["key"] // 512, []).append((r["key"] % 512 - 128, r["n"]))
    for lv, cells in by.items():
        x = np.array([0 if c == -128 else 2.0 ** (c / 4) for c, _ in cells])
        n = np.array([k for _, k in cells], float)
        s = 0.3
        for _ in range(50):
            s = float((n * s * x / (s * x + 1 - s)).sum() / (n.sum() + 1))
            s = min(max(s, 1e-6), 0.999)
        share[lv] = s
    return share


SCORED = "_row long, doc_id long, n_tokens long, base double, n_known long, score double"


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first, levels in _token_levels(batches):
            lv, pair, single = model.parts(*levels)
            s = model.share[lv]
            score = K.sums(np.log10(s * pair + (1 - s) * single), first)
            names = ["_row", "doc_id", "n_tokens", "base", "n_known"]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in names), pa.array(score)], names=[*names, "score"])

    return run


BLOCKS = "block long, row long, doc_id long, t string, known boolean"
ASKED = "block long, row long, part int, kind int, keys binary"


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts with their number and that of their block."""
    task = TaskContext.get()
    at_task = task.partitionId() if task else 0
    block, row = at_task << 32, at_task << 40
    for batch in batches:
        for lo, hi in K.slices(K.utf8(batch.column(1))[1], BLOCK_BYTES):
            n = hi - lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(np.arange(row, row + n)), *(c.slice(lo, n) for c in batch.columns)],
                names=["block", "row", "doc_id", "t", "known"],
            )
            block, row = block + 1, row + n


def _ask_batches(bits: int):
    """The distinct n-grams of each run of a block's texts by part; ``row`` is the run's first text.

    A block that is read by two tasks or in two batches asks in two runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, rows = (batch.column(k).to_numpy() for k in ("block", "row"))
            data, offsets = K.utf8(batch.column(2))
            cut = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
            for lo, hi in zip(cut, np.append(cut[1:], len(blocks))):
                at = offsets[lo : hi + 1]
                word, before, _ = tokens(data[at[0] : at[-1]], at - at[0])
                parts, kinds, keys = [], [], []
                for kind, key in enumerate((np.unique(word), np.unique(pair_key(before, word)))):
                    part, low = _place(key, bits)
                    for p, x in zip(*_cut(part, low)):
                        parts.append(p)
                        kinds.append(kind)
                        keys.append(_pack(p, 1, x, np.zeros(0))[2])
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, blocks[lo])), pa.array(np.full(n, rows[lo])),
                        pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()),
                    ],
                    names=["block", "row", "part", "kind", "keys"],
                )

    return run


def _cut(part: np.ndarray, low: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Keys of each part, which stand together."""
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return part[at].tolist(), np.split(low, at[1:])


ANSWERED = "block long, row long, part int, kind int, levels binary"


def _look_up(bits: int, size: int):
    """Levels of the n-grams asked of a part."""

    def run(asked: pa.Table, segments: pa.Table) -> pa.Table:
        data = np.zeros((1, size // 8), np.uint8)
        for segment in segments.column("segment"):
            data[0] |= np.frombuffer(segment.as_buffer(), np.uint8)
        part = Filter(bits, size, data)
        kinds = asked.column("kind").to_numpy()
        keys = pc.binary_length(asked.column("keys")).to_numpy() // 6
        out = [b""] * len(kinds)
        for kind in (0, 1):
            rows = np.flatnonzero(kinds == kind)
            ends = np.append(0, np.cumsum(keys[rows]))
            for lo, hi in K.slices(ends, ASKED_KEYS):
                raw = asked.column("keys").take(pa.array(rows[lo:hi])).to_pylist()
                low = _unpack(1, b"".join(raw))
                levels = part.levels_at(np.zeros(len(low), np.int64), low, kind).astype(np.uint8)
                for row, found in zip(rows[lo:hi], np.split(levels, ends[lo + 1 : hi] - ends[lo])):
                    out[row] = found.tobytes()
        return asked.select(["block", "row", "part", "kind"]).append_column("levels", pa.array(out, pa.binary()))

    return run


def _block_runs(texts: pa.Table, answers: pa.Table) -> Iterator[tuple[pa.Table, tuple, Looked]]:
    """Each run of a block's texts, its tokens, and the levels of its distinct words and pairs."""
    texts = texts.sort_by("row")
    first = np.unique(answers.column("row").to_numpy())
    cut = np.append(np.searchsorted(texts.column("row").to_numpy(), first), texts.num_rows)
    said = sorted(
        answers.select(["row", "kind", "part", "levels"]).to_pylist(), key=lambda r: (r["row"], r["kind"], r["part"])
    )
    for row, lo, hi in zip(first, cut[:-1], cut[1:]):
        run = texts.slice(lo, hi - lo)
        levels = (b"".join(r["levels"] for r in said if r["row"] == row and r["kind"] == kind) for kind in (0, 1))
        words, pairs = (np.frombuffer(x, np.uint8).astype(np.int64) for x in levels)
        yield run, tokens(*K.utf8(run.column("t").combine_chunks())), (words, pairs)


def _level_block(held):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for rows, text, looked in _block_runs(texts, answers):
            columns = (rows.column(k).combine_chunks() for k in ("row", "doc_id", "known"))
            out.append(pa.table(_levelled(held.value, *columns, text, looked)))
        return pa.concat_tables(out)

    return run


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
            n = np.frombuffer(counts, np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_unpack(0, keys).view(np.int64)), pa.array(n)], names=["word", "n"]
            )


def score(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", max_bits: int | None = None
) -> DataFrame:
    """Scores of every row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where ``training`` holds.  Null text counts
    as empty: one end token.  Words are known by 64-bit hashes.  Without
    training rows every probability is that of an empty model.  Null and
    repeated ids are scored row by row; an empty table gives no rows; other
    columns are ignored.  A filter of more than ``max_bits`` is not broadcast.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")
    known = docs.filter(training)
    slots = max(16, 4 * docs.rdd.getNumPartitions())
    bits = min(16, (slots - 1).bit_length())
    with shuffles_freed(spark):
        counted = stage(
            known.select(text).mapInArrow(_count_batches(bits), COUNTED).groupBy("part")
            .applyInArrow(_merge_counts, COUNTED + ", grams array<long>, total array<long>"),
            "counts",
        )
        levels = (
            counted.select("kind", F.posexplode(F.arrays_zip("grams", "total"))).groupBy("kind", "pos")
            .agg(F.sum("col.grams").alias("grams"), F.sum("col.total").alias("total")).collect()  # 2 * LEVELS rows
        )
    grams, total = np.zeros((2, LEVELS + 1), np.int64), np.zeros((2, LEVELS + 1), np.int64)
    for r in levels:
        grams[r["kind"], r["pos"]], total[r["kind"], r["pos"]] = r["grams"], r["total"]
    items = int((grams * np.arange(LEVELS + 1)).sum())
    size = 1 << max(10, int(np.ceil(np.log2(max(1, items * PER_ITEM) / (1 << bits)))))
    segments = counted.select("part", "kind", "keys", "counts").mapInArrow(
        _segment_batches(bits, size), "part int, segment binary"
    )
    whole = None
    if items * PER_ITEM <= (MAX_BITS if max_bits is None else max_bits):
        data = np.zeros((1 << bits, size // 8), np.uint8)
        for r in segments.collect():  # 2 * MAX_BITS at most
            data[r["part"]] |= np.frombuffer(r["segment"], np.uint8)
        whole = Filter(bits, size, data)
    words = counted.filter("kind = 0").select("keys", "counts").mapInArrow(_word_batches, "word long, n long")
    above = grams[0][::-1].cumsum()[::-1]  # words of at least each level
    cut = int(np.flatnonzero(above <= HEAD_WORDS)[0]) if (above <= HEAD_WORDS).any() else LEVELS
    floor = int(LOWER[cut - 1]) if cut > 0 else 0
    head = words.filter(F.col("n") >= floor).toPandas()  # HEAD_WORDS rows at most
    head_word = head["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(head_word)
    n_docs = int(head.loc[head["word"] == END.view(np.int64), "n"].sum())
    model = Model(
        whole, int(total[0].sum()), int(grams[0].sum()), n_docs, np.zeros(LEVELS + 1),
        head_word[order], head["n"].to_numpy(np.int64)[order],
    )
    doc_id = F.col(f"`{id_col}`").cast("long").alias("doc_id")
    texts = docs.select(doc_id, text, F.coalesce(training, F.lit(False)).alias("known"))
    held = spark.sparkContext.broadcast(model)
    if whole is not None:
        found = texts.mapInArrow(_level_batches(held), LEVELLED)
    else:
        blocks = stage(texts.mapInArrow(_block_batches, BLOCKS), "blocks")
        asked = blocks.select("block", "row", "t").mapInArrow(_ask_batches(bits), ASKED)
        with shuffles_freed(spark):
            answers = stage(
                asked.groupBy("part").cogroup(segments.groupBy("part")).applyInArrow(_look_up(bits, size), ANSWERED), "answers"
            )
        found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_level_block(held), LEVELLED)
    with shuffles_freed(spark):
        levelled = stage(found, "levels")
    held.unpersist()
    model = replace(model, filter=None, head=model.head[:0], head_count=model.head_count[:0])  # what the levels leave to do
    cells = levelled.filter("known").select("words", "pairs").mapInArrow(_share_batches(model), CELLS)
    with shuffles_freed(spark):
        model = replace(model, share=_fit_shares(cells.groupBy("key").agg(F.sum("n").alias("n")).collect()))
    scored = levelled.drop("known", "tail").mapInArrow(_score_batches(model), SCORED)
    rare = levelled.select("_row", F.explode("tail").alias("word")).join(words.filter(F.col("n") < floor), "word", "left")
    scale = F.lit(float(np.log10(model.n + 0.5 * (model.v + 1))))
    rare = rare.groupBy("_row").agg(
        F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5) - scale).alias("_base"), F.count("n").alias("_known")
    )
    return scored.join(rare, "_row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
