"""Hierarchical multi-length packing of token streams.

Every map task packs the documents it reads, a bounded group of tokens at a
time, so no text is shuffled.  In a group:

1. Routing: a document goes to the tier of its length; the head of one longer
   than the window becomes full windows of the top tier and its rest is routed.
2. Each tier is packed by itself: documents fill windows of the tier's size,
   largest first, one document opening each window.
3. Gaps of long windows are filled from the shorter tiers, longest tier first,
   cutting a document where the gap ends.
4. What is left when no shorter document remains is cut into windows whose
   sizes are powers of two, so that it needs no padding.

Sequences are dealt to step groups of about equal token counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
GROUP_TOKENS = 1 << 21
STEP_SEQUENCES = 64
END_ID = 1
CACHE_WORDS = 800_000  # units kept by a worker; beyond that the memory starts anew

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, step_id long"
)


#: White space of Unicode, as the tokenizer's pattern means it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NEWLINE_ID = 198  # of the line break alone, in this vocabulary


class _Numbers(dict):
    """Numbers units as they are first asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the JSON file beside a file of ranks, with their ids."""
    import json
    from pathlib import Path

    said = json.loads(Path(path).with_suffix(".json").read_text(encoding="utf-8"))["added_tokens"]
    for t in said:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["id"] >= 1 << 16:
            raise ValueError(f"added token {t['content']!r} is not matched as it stands")
    return {t["content"]: t["id"] for t in said}


class PieceTokenizer:
    """Token ids of texts, each distinct unit encoded once.

    Byte-level BPE never merges across pre-tokens and no pre-token goes on
    after a space, so the ids of a text are the ids of its units joined: words
    with the space before them, and runs of white space.  The vocabulary is the
    file of ranks, which gives the ids of the JSON file of the same vocabulary.
    The added tokens of that JSON file are found in the text first, as they
    stand, and are units of their own with their own id.
    """

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.coder = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.added = added_tokens(path)
        self.pieces = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        # the longest of those that start at one place
        between = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.apart = re.compile(f"({between})").split if between else None
        self.spaces = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))
        self._clear()

    def split(self, text: str) -> list[str]:
        """Units of a text; the places of the added tokens end the text around them."""
        if not any(a in text for a in self.added):
            return self.pieces(text)
        parts = enumerate(self.apart(text))
        return [u for k, part in parts for u in ([part] if k % 2 else self.pieces(part))]

    def _clear(self) -> None:
        self.known = _Numbers()
        self.ids = np.zeros(1 << 16, np.uint16)
        self.lo = np.zeros(1 << 16, np.int64)  # where the ids of each known unit start
        self.size = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _coded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units in one array, and where those of each unit start and how many they are."""
        blank = np.array([u[-1] in self.spaces or u in self.added for u in units], bool)
        # a line break before each unit is always a pre-token of its own
        words = [u for u, b in zip(units, blank) if not b] if blank.any() else units
        joined = np.array(self.coder("\n" + "\n".join(words) if words else ""), np.uint16)
        breaks = np.flatnonzero(joined == NEWLINE_ID)
        alone = [[self.added[u]] if u in self.added else self.coder(u) for u, b in zip(units, blank) if b] if blank.any() else []
        flat = np.concatenate([joined, *[np.array(x, np.uint16) for x in alone]])
        size = np.zeros(len(units), np.int64)
        lo = np.zeros(len(units), np.int64)
        size[~blank] = np.diff(np.append(breaks, len(joined))) - 1
        lo[~blank] = breaks + 1
        size[blank] = [len(x) for x in alone]
        lo[blank] = len(joined) + np.cumsum(size[blank]) - size[blank]
        return flat, lo, size

    def _learn(self) -> None:
        """Encode the units numbered since the last call."""
        units, self.known.new = self.known.new, []
        flat, lo, size = self._coded(units)
        n, end = len(self.known), self.used + len(flat)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n > len(self.lo):
            self.lo = np.concatenate([self.lo, np.zeros_like(self.lo)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used : end] = flat
        self.lo[n - len(units) : n] = self.used + lo
        self.size[n - len(units) : n] = size
        self.used = end

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self._clear()
        number = self.known.__getitem__
        codes = [np.array(list(map(number, self.split(t))), np.int64) for t in texts]
        if self.known.new:
            self._learn()
        out = []
        for code in codes:
            size = self.size[code]
            end = np.cumsum(size)
            total = int(end[-1]) if len(end) else 0
            out.append(self.ids[np.arange(total) + np.repeat(self.lo[code] - end + size, size)])
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_tokenizers: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """The worker's tokenizer for the file: loaded once."""
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


def pack_lengths(lengths: list[int], window: int = WINDOW, tiers=TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length) for documents of these lengths.

    Every position of every document lies in exactly one piece.  All sequences
    but those of the last cut are full windows.
    """
    done: list[list[tuple[int, int, int]]] = []
    waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= window:
            done.append([(d, at, window)])
            at += window
        if n > at:
            fits = [t for t in tiers if t >= n - at]
            waiting[fits[-1]].append((d, at, n - at))
    for t in tiers:  # ascending, so that the largest is taken first
        waiting[t].sort(key=lambda x: (x[2], -x[0]))
    order = list(tiers)
    spill: list[tuple[int, int, int]] = []  # rests of cut documents, taken before others
    for k, t in enumerate(order):
        while waiting[t]:
            sequence = [waiting[t].pop()]
            room = t - sequence[0][2]
            while room:
                if spill:
                    d, at, n = spill.pop()
                else:
                    source = next((s for s in order[k + 1 :] if waiting[s]), None)
                    if source is None:
                        # nothing shorter is left: the tier's own smallest document fills the gap
                        if not waiting[t]:
                            break
                        d, at, n = waiting[t].pop(0)
                    else:
                        d, at, n = waiting[source].pop()
                take = min(n, room)
                sequence.append((d, at, take))
                room -= take
                if n > take:
                    spill.append((d, at + take, n - take))
            if room:
                done += _by_powers_of_two(sequence)
            else:
                done.append(sequence)
    while spill:
        done += _by_powers_of_two([spill.pop()])
    return done


def _by_powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    total = sum(n for _, _, n in pieces)
    out, queue = [], list(reversed(pieces))
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        sequence = []
        while size:
            d, at, n = queue.pop()
            take = min(n, size)
            sequence.append((d, at, take))
            size -= take
            if n > take:
                queue.append((d, at + take, n - take))
        out.append(sequence)
    return out


def _pack_batches(path: str, end_id: int, group_tokens: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        next_id = (task.partitionId() if task else 0) << 40
        encode = tokenizer(path).encode_all
        ids: list[object] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id, ids, tokens, held
            packed = pack_lengths([len(t) for t in tokens])
            # full sequences first, then step groups get every k-th: equal counts, equal tokens
            packed.sort(key=lambda s: -sum(n for _, _, n in s))
            groups = max(1, -(-len(packed) // step))
            rows = []
            for k, sequence in enumerate(packed):
                at = 0
                size = sum(n for _, _, n in sequence)
                tier = next((t for t in reversed(TIERS) if t >= size), WINDOW)
                for d, start, n in sequence:
                    crc = zlib.crc32(tokens[d][start : start + n].astype("<u4").tobytes())
                    rows.append((ids[d], start, n, crc, len(tokens[d]), next_id + k, at, tier, next_id + k % groups))
                    at += n
            next_id += len(packed)
            ids, tokens, held = [], [], 0
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = encode([t or "" for t in part.column(1).to_pylist()])
                for d, t in zip(part.column(0).to_pylist(), texts):
                    t = np.append(t, np.uint16(end_id))
                    if held and held + len(t) > group_tokens:
                        yield flush()
                    ids.append(d)
                    tokens.append(t)
                    held += len(t)
        if ids:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    group_tokens: int = GROUP_TOKENS,
    step: int = STEP_SEQUENCES,
) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most WINDOW tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier (the context size that holds the sequence), step_id (its balanced
    group).  A null or empty text is its end token alone.  Null and repeated
    ids are packed like others, one row after another.  An empty table gives no
    rows; other columns are ignored.  Sequence ids follow the input splits, so
    a task that runs again gives the same rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.mapInArrow(_pack_batches(tokenizer_path, end_id, group_tokens, step), SCHEMA)
