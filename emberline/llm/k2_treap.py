"""K2-treap: a compressed quadtree of a sparse grid whose cells store maxima.

Every node covers a square of the grid and holds the largest of its points,
which is then missing from the squares below; a node's four children are the
quarters that still have points.  Nodes are stored level by level: four bits
for the children, the place of the maximum inside the square, and the
difference of its value to the parent's, each with as many bits as the level
needs.  A child's number follows from the count of set bits before it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from emberline.llm.elias_fano import pack_bits, unpack_bits

_HEAD = struct.Struct("<BB")  # height, levels
_LEVEL = struct.Struct("<QBIIII")  # nodes, bits of a value, bytes of the four parts
#: set bits of a nibble below bit q
BEFORE = np.array([[bin(v & ((1 << q) - 1)).count("1") for q in range(4)] for v in range(16)], np.int64)
_COUNT = np.array([bin(v).count("1") for v in range(16)], np.int64)
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(v: np.ndarray) -> np.ndarray:
    """A zero bit before every bit of 32-bit numbers."""
    v = v.astype(np.uint64)
    for shift, mask in _MASKS:
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def _first_of_runs(v: np.ndarray) -> np.ndarray:
    new = np.ones(len(v), bool)
    np.not_equal(v[1:], v[:-1], out=new[1:])
    return np.flatnonzero(new)


def build(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> bytes:
    """The tree's bytes for distinct points with values from 0; rows and columns below 2**32."""
    height = max(1, int(max(row.max(), col.max())).bit_length()) if len(row) else 1
    code = (_spread(row) << np.uint64(1)) | _spread(col)
    order = np.argsort(code)
    code, row, col, value = code[order], row[order], col[order], value[order]
    levels: list[tuple] = []  # cells, values, rows, columns, nibbles
    while len(code):
        depth = len(levels)
        cell = code >> np.uint64(2 * (height - depth))
        start = _first_of_runs(cell)
        size = np.diff(np.append(start, len(cell)))
        top = np.maximum.reduceat(value, start)
        hit = np.flatnonzero(value == np.repeat(top, size))
        chosen = hit[_first_of_runs(np.repeat(np.arange(len(start)), size)[hit])]
        levels.append((cell[start], top, row[chosen], col[chosen], np.zeros(len(start), np.uint64)))
        if depth:
            parent = np.searchsorted(levels[-2][0], cell[start] >> np.uint64(2))
            bits = (1 << (cell[start] & np.uint64(3)).astype(np.int64)).astype(np.float64)
            levels[-2][4][:] = np.bincount(parent, bits, len(levels[-2][0])).astype(np.uint64)
            levels[-1] = (*levels[-1], levels[-2][1][parent] - top)
        else:
            levels[-1] = (*levels[-1], top)
        rest = np.ones(len(code), bool)
        rest[chosen] = False
        code, row, col, value = code[rest], row[rest], col[rest], value[rest]
    out = [_HEAD.pack(height, len(levels))]
    for depth, (_, _, row, col, nibble, less) in enumerate(levels):
        width, bits = int(less.max()).bit_length(), height - depth
        mask = np.uint64((1 << bits) - 1)
        parts = [
            pack_bits(nibble, 4), pack_bits(row.astype(np.uint64) & mask, bits),
            pack_bits(col.astype(np.uint64) & mask, bits), pack_bits(less.astype(np.uint64), width),
        ]
        out += [_LEVEL.pack(len(nibble), width, *map(len, parts)), *parts]
    return b"".join(out)


@dataclass
class K2Treap:
    """An opened tree: of every node the child bits, the number of the first child, and its maximum."""

    height: int
    nibble: np.ndarray
    child: np.ndarray
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray

    @classmethod
    def read(cls, data: bytes | memoryview) -> K2Treap:
        view = memoryview(data)
        height, depth = _HEAD.unpack_from(view)
        at, kept, above = _HEAD.size, [], None
        for level in range(depth):
            n, width, *sizes = _LEVEL.unpack_from(view, at)
            at += _LEVEL.size
            bits, parts = height - level, []
            for size, w in zip(sizes, (4, bits, bits, width)):
                parts.append(unpack_bits(view[at : at + size], n, w).astype(np.int64))
                at += size
            nibble, row, col, value = parts
            if above is None:
                base_row = base_col = np.zeros(1, np.int64)
            else:
                index = np.flatnonzero((above[0][:, None] >> np.arange(4)) & 1)
                parent, q = index >> 2, index & 3
                base_row, base_col = above[1][parent] * 2 + (q >> 1), above[2][parent] * 2 + (q & 1)
                value = above[3][parent] - value
            above = (nibble, base_row, base_col, value)
            kept.append((nibble.astype(np.uint8), (base_row << bits) + row, (base_col << bits) + col, value))
        nibble, row, col, value = (np.concatenate(x) for x in zip(*kept)) if kept else [np.zeros(0, np.int64)] * 4
        count = _COUNT[nibble]
        return cls(height, nibble, 1 + np.cumsum(count) - count, row, col, value)


def best_columns(
    tree: K2Treap, item: np.ndarray, row: np.ndarray, weight: np.ndarray, tie: np.ndarray, k: int, wave: int = 32
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item the ``k`` columns with the largest weighted sums over the item's rows.

    ``item``, ``row`` and ``weight`` (above 0) name the rows of each item, once
    each; items are numbered from 0.  Equal sums go by the smaller ``tie`` of
    the column.  Returns (item, column, sum) with sums above 0.

    An entry is a range of columns of one item, with the path of each of its
    rows: the node that covers the row and the range, and the maxima of that
    row met above.  Their weighted values bound any column's sum.  The entries
    with the largest bounds, a wave for each item, are halved; all row paths of
    an entry descend together, and a single column's bound is its sum.  Entries
    whose bound cannot reach the k-th sum are dropped, so the result is exact.
    """
    n_items = int(item.max()) + 1 if len(item) else 0
    found = [np.zeros(0, np.int64)] * 3
    if n_items == 0 or len(tree.nibble) == 0:
        return tuple(found)
    by = np.argsort(item, kind="stable")
    item, row, weight = item[by], row[by], weight[by]
    local = np.arange(len(item)) - np.searchsorted(item, item)
    weights = np.zeros((n_items, int(local.max()) + 1), np.int64)
    weights[item, local] = weight
    lowest = [tie]  # of aligned ranges of columns, for each level from the last
    for _ in range(tree.height):
        lowest.append(np.minimum.reduceat(lowest[-1], np.arange(0, len(lowest[-1]), 2)))
    lowest.reverse()
    start = np.cumsum([0, *map(len, lowest)])
    lowest = np.concatenate(lowest)

    first = tree.row[0] == row
    some = np.flatnonzero(first)
    e_item = np.arange(n_items)
    e_level, e_base = np.zeros(n_items, np.int64), np.zeros(n_items, np.int64)
    e_bound = (weights * tree.value[0]).sum(1)
    s_entry, s_slot, s_node = item.copy(), np.arange(len(item)), np.zeros(len(item), np.int64)
    p_entry, p_slot = item[some], some
    p_col, p_value = np.full(len(some), tree.col[0]), np.full(len(some), tree.value[0])
    least, last = np.zeros(n_items, np.int64), np.full(n_items, np.iinfo(np.int64).min)
    best = [*found, np.zeros(0, np.int64)]  # item, sum, tie, column
    rounds = 0
    while len(e_item):
        low = lowest[start[e_level] + e_base]
        alive = (e_bound > least[e_item]) | ((e_bound == least[e_item]) & (low < last[e_item]))
        order = np.lexsort((-e_bound, ~alive, e_item))
        place = np.arange(len(order)) - np.searchsorted(e_item[order], e_item[order])
        chosen = np.zeros(len(order), bool)
        chosen[order[place < wave << min(rounds // 8, 7)]] = True
        chosen &= alive
        rounds += 1
        stays = alive & ~chosen

        # both halves of the chosen entries
        number = np.cumsum(chosen) - 1
        own, pending = chosen[s_entry], chosen[p_entry]
        entry, slot, node = number[s_entry[own]], s_slot[own], s_node[own]
        shift = tree.height - 1 - e_level[chosen]
        quarter = ((row[slot] >> shift[entry]) & 1) * 2
        nibble = tree.nibble[node]
        new_s, new_p = [], []
        half = (p_col[pending] >> shift[number[p_entry[pending]]]) & 1
        new_p.append((number[p_entry[pending]] * 2 + half, p_slot[pending], p_col[pending], p_value[pending]))
        for c in (0, 1):
            there = np.flatnonzero((nibble >> (quarter + c)) & 1)
            child = tree.child[node[there]] + BEFORE[nibble[there], quarter[there] + c]
            new_s.append((entry[there] * 2 + c, slot[there], child))
            mine = tree.row[child] == row[slot[there]]
            new_p.append((entry[there][mine] * 2 + c, slot[there][mine], tree.col[child[mine]], tree.value[child[mine]]))
        c_entry, c_slot, c_node = (np.concatenate(x) for x in zip(*new_s))
        deeper = tree.nibble[c_node] > 0
        c_entry, c_slot, c_node = c_entry[deeper], c_slot[deeper], c_node[deeper]
        q_entry, q_slot, q_col, q_value = (np.concatenate(x) for x in zip(*new_p))

        c_item = np.repeat(e_item[chosen], 2)
        c_level = np.repeat(e_level[chosen] + 1, 2)
        c_base = np.repeat(e_base[chosen] * 2, 2) + np.tile([0, 1], int(chosen.sum()))
        most = np.zeros((len(c_item), weights.shape[1]), np.int64)
        most[c_entry, local[c_slot]] = tree.value[c_node]
        np.maximum.at(most, (q_entry, local[q_slot]), q_value)
        c_bound = (most * weights[c_item]).sum(1)

        done = (c_level == tree.height) & (c_bound > 0)
        if done.any():
            col = c_base[done]
            best = [np.concatenate(x) for x in zip(best, (c_item[done], c_bound[done], tie[col], col))]
            order = np.lexsort((best[2], -best[1], best[0]))
            best = [b[order] for b in best]
            place = np.arange(len(order)) - np.searchsorted(best[0], best[0])
            best = [b[place < k] for b in best]
            kth = place[place < k] == k - 1
            least[best[0][kth]], last[best[0][kth]] = best[1][kth], best[2][kth]

        goes_on = (c_level < tree.height) & (c_bound > 0)
        parts = []
        for keep, s, p in (
            (stays, (s_entry, s_slot, s_node), (p_entry, p_slot, p_col, p_value)),
            (goes_on, (c_entry, c_slot, c_node), (q_entry, q_slot, q_col, q_value)),
        ):
            number, ours, theirs = np.cumsum(keep) - 1, keep[s[0]], keep[p[0]]
            parts.append(((number[s[0][ours]], *(x[ours] for x in s[1:])), (number[p[0][theirs]], *(x[theirs] for x in p[1:]))))
        n = int(stays.sum())
        (old_s, old_p), (add_s, add_p) = parts
        s_entry, s_slot, s_node = (np.concatenate(x) for x in zip(old_s, (add_s[0] + n, *add_s[1:])))
        p_entry, p_slot, p_col, p_value = (np.concatenate(x) for x in zip(old_p, (add_p[0] + n, *add_p[1:])))
        e_item, e_level, e_base, e_bound = (
            np.concatenate([a[stays], b[goes_on]])
            for a, b in ((e_item, c_item), (e_level, c_level), (e_base, c_base), (e_bound, c_bound))
        )
    return best[0], best[3], best[1]
