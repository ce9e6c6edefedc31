"""Suffix arrays over word hashes, sorted to a stated depth, for shards that fit a task."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first `depth` symbols, and their ranks.

    ends[i] is where the text of position i stops. Suffixes have equal ranks
    exactly if their first `depth` symbols (or all, where fewer are left) are
    equal: they are the leaves under one node of the suffix tree at that depth.
    Prefix doubling, and only suffixes that still tie are sorted again.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(symbols)
    fresh = np.ones(n, bool)
    fresh[1:] = symbols[order][1:] != symbols[order][:-1]
    heads = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    sizes = np.diff(np.append(heads, n))
    rank[order] = np.repeat(heads + 1, sizes)
    active = np.flatnonzero(np.repeat(sizes > 1, sizes))
    done = 1
    while done < depth and len(active):
        step = min(done, depth - done)
        at = order[active]
        follow = at + step
        inside = follow < ends[at]
        key = (rank[at] << 32) | np.where(inside, rank[np.minimum(follow, n - 1)], 0)
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[active] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(at)))
        rank[at] = np.repeat(active[heads] + 1, sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        done += step
    return order, rank


def find(symbols: np.ndarray, ends: np.ndarray, order: np.ndarray, asked: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of each asked[at : at + length]: the range of `order` that starts with it.

    The array must be sorted to a depth of max(lengths) at least.
    """
    n = len(order)
    column = np.arange(int(lengths.max()) if len(lengths) else 0)

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
        while True:
            every = np.flatnonzero(lo < hi)
            if not len(every):
                return lo
            for first in range(0, len(every), 1 << 17):  # bounds the tables below
                todo = every[first : first + (1 << 17)]
                mid = (lo[todo] + hi[todo]) // 2
                own = order[mid]
                where = own[:, None] + column
                seen = np.where(where < ends[own][:, None], symbols[np.minimum(where, n - 1)], np.uint64(0))
                want = asked[np.minimum(at[todo][:, None] + column, len(asked) - 1)]
                differs = (seen != want) & (column[None, :] < lengths[todo][:, None])
                place = differs.argmax(1)
                row = np.arange(len(todo))
                below = np.where(differs[row, place], seen[row, place] < want[row, place], after)
                lo[todo] = np.where(below, mid + 1, lo[todo])
                hi[todo] = np.where(below, hi[todo], mid)

    return bound(False), bound(True)
