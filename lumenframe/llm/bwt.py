"""Burrows-Wheeler transforms of string collections and their merge by interleave refinement.

Strings are rows of symbols of equal width; symbol 0 ends every string. A
shard's transform is built from its own suffixes; two transforms are merged
by refining an interleave bit by bit of context (Holt and McMillan, 2014):
round h moves every entry to its symbol's range in the order of round h - 1,
after which suffixes are ordered by their first h symbols. Where a block of
equal suffixes first splits gives their common prefix, so neither shard's
suffixes are sorted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _radix_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of non-negative keys below 2**32, by 16-bit digits."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high = (keys >> 16).astype(np.uint16)
    if high.any():
        order = order[np.argsort(high[order], kind="stable")]
    return order


@dataclass
class Transform:
    """symbols: the transform; who: the strings whose first suffix stands at each 0, in order; lcp: common symbols with the entry before, once merged."""

    symbols: np.ndarray
    who: np.ndarray
    lcp: np.ndarray


def build(words: np.ndarray, names: np.ndarray) -> Transform:
    """Transform of one shard, words[i] being string names[i] in symbols above 0."""
    count, width = words.shape
    if not count:
        return Transform(np.zeros(0, np.int64), names, np.zeros(0, np.int64))
    full = np.zeros((count, width + 1), np.int64)
    full[:, :width] = words
    rank, span = full.copy(), 1
    while span <= width:
        after = np.zeros_like(rank)
        after[:, :-span] = rank[:, span:]
        pair = rank * (int(rank.max()) + 1) + after
        _, flat = np.unique(pair, return_inverse=True)
        rank = flat.reshape(rank.shape) + 1
        rank[full == 0] = 0
        span *= 2
    order = np.argsort(rank.ravel(), kind="stable")
    before = np.zeros_like(full)
    before[:, 1:] = full[:, :-1]
    symbols = before.ravel()[order]
    row, at = np.divmod(order, width + 1)
    return Transform(symbols, names[row[at == 0]], np.zeros(0, np.int64))


def merge(left: Transform, right: Transform) -> Transform:
    """Transform of both collections; entries of left come first among equals."""
    n, ends = len(left.symbols) + len(right.symbols), len(left.who) + len(right.who)
    side = np.zeros(n, bool)
    side[len(left.symbols) :] = True
    block = np.zeros(n, np.int64)
    lcp = np.full(n, -1, np.int64)
    both = np.empty(n, np.int64)
    h = 0
    while True:
        both[~side], both[side] = left.symbols, right.symbols
        order = _radix_order(both)
        moved, symbols, was = side[order], both[order], block[order]
        # end marks are all equal; those of left stay first
        moved[:ends] = np.arange(ends) >= len(left.who)
        edge = np.ones(n, bool)
        edge[1:] = (symbols[1:] != symbols[:-1]) | (was[1:] != was[:-1])
        edge[1:ends] = False
        fresh = edge & (lcp < 0)
        lcp[fresh] = h
        settled = h > 0 and np.array_equal(moved, side) and not fresh.any()
        side, block, h = moved, np.cumsum(edge), h + 1
        if settled:
            break
    both[~side], both[side] = left.symbols, right.symbols
    # entries that never part are equal suffixes, at most as long as a string
    lcp[lcp < 0] = h
    first = both == 0
    who = np.empty(ends, np.int64)
    of = side[first]
    who[~of], who[of] = left.who, right.who
    return Transform(both, who, lcp)


def first_suffixes(t: Transform) -> tuple[np.ndarray, np.ndarray]:
    """Strings in lexicographic order, and how many symbols each shares with the one before."""
    at = np.flatnonzero(t.symbols == 0)
    if not len(at):
        return t.who, np.zeros(0, np.int64)
    shared = np.zeros(len(at), np.int64)
    if len(at) > 1:
        shared[1:] = np.minimum.reduceat(t.lcp[: at[-1] + 1], at[:-1] + 1)
    return t.who, shared
