"""Burrows-Wheeler transforms of small collections of byte strings, and their merge.

A shard is a set of strings, each followed by a mark of its own that is larger than any byte.  Its
transform is a byte a suffix, in sorted order; where each string begins is listed beside it, and
for neighbours whether they share their first `width` symbols.  From the transform alone come the
step to the next suffix (psi) and the symbols that follow, so shards are merged without their texts.

The merge refines an interleave: at first the suffixes of all shards lie in one block, those of a
shard in its order.  Each round reads the next STEP symbols of the suffixes in blocks where shards
mix, by psi, and parts the blocks by them.  A block of one shard is settled, since what its suffixes
share is known there.  Blocks that still mix after `width` symbols are the intervals that shards have
in common.
"""

from __future__ import annotations

import numpy as np

#: Symbols of nine bits in a word: bytes, and the mark behind a string.
STEP, SYMBOL, MARK = 7, 9, 256


def _heads(new: np.ndarray) -> np.ndarray:
    """For each place the place of the last True at or before it."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _shared(new: np.ndarray) -> np.ndarray:
    """Which places are in a group of more than one; True begins a group."""
    return ~(new & np.append(new[1:], True))


class Shard:
    """Transform, ranks of the strings' beginnings, and whether a suffix shares `width` symbols with the one before."""

    __slots__ = ("bwt", "same", "starts")

    def __init__(self, bwt: np.ndarray, starts: np.ndarray, same: np.ndarray):
        self.bwt, self.starts, self.same = bwt, starts, same


def transform(data: np.ndarray, size: np.ndarray, width: int) -> Shard:
    """The shard of the strings that lie one after the other in data, of the given sizes; width is STEP at least."""
    end = np.cumsum(size + 1) - 1  # where each mark stands
    n = len(data) + len(size)
    symbol = np.full(n, MARK, dtype=np.int64)
    text = np.ones(n, dtype=bool)
    text[end] = False
    symbol[text] = data
    left = np.repeat(end, size + 1) - np.arange(n)  # symbols before the mark
    padded = np.concatenate([symbol, np.full(STEP, MARK)])
    word = np.zeros(n, dtype=np.int64)
    for j in range(STEP):
        word = (word << SYMBOL) | np.where(j < left, padded[j : j + n], MARK)
    order = np.argsort(word)
    new = np.ones(n, dtype=bool)
    new[1:] = word[order[1:]] != word[order[:-1]]
    marked = np.flatnonzero(left[order] < STEP)  # a mark within reach: alone, in the order of the strings
    order[marked] = order[marked][np.lexsort((order[marked], _heads(new)[marked]))]
    new[marked] = True
    rank = np.empty(n, dtype=np.int64)
    rank[order] = _heads(new)
    known, snapshot, slot = STEP, None, np.flatnonzero(_shared(new))
    while True:
        if known * 2 > width >= known and snapshot is None:
            snapshot = known, rank.copy()
        if not len(slot):
            break
        at = order[slot]
        key = rank[at] * n + rank[at + known]  # no mark within reach, so at + known lies in the string
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slot] = at
        first = np.ones(len(slot), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        rank[at] = slot[_heads(first)]
        slot = slot[_shared(first)]  # groups of more than one: the others are settled
        known *= 2
    same = np.zeros(n, dtype=bool)
    if snapshot is not None:  # two overlapping runs of `known` symbols make up the width
        known, part = snapshot
        a, b = order[:-1], order[1:]
        long = np.flatnonzero((left[a] >= width) & (left[b] >= width))
        a, b = a[long], b[long]
        same[1 + long] = (part[a] == part[b]) & (part[a + width - known] == part[b + width - known])
    return Shard(symbol[order - 1].astype(np.uint8), rank[np.concatenate([[0], end[:-1] + 1])] if len(size) else rank[:0], same)


class Walk:
    """What a transform tells of its suffixes: the next suffix, STEP symbols, and the suffix behind them."""

    def __init__(self, shard: Shard):
        symbol = shard.bwt.astype(np.uint16)
        symbol[shard.starts] = MARK
        self.psi = np.argsort(symbol, kind="stable").astype(np.int32)
        first = np.repeat(np.arange(MARK + 1), np.bincount(symbol, minlength=MARK + 1))
        ends = np.flatnonzero(first == MARK)
        self.psi[ends] = ends  # nothing follows a mark but itself
        self.word, self.skip = first.copy(), self.psi
        for _ in range(STEP - 1):
            self.word <<= SYMBOL
            self.word |= first[self.skip]
            self.skip = self.psi[self.skip]

    def places(self, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, string, offset) of the first n[u] suffixes of each string u, followed from its beginning."""
        by = np.argsort(-n, kind="stable")
        out, at = [], starts[by]
        for j in range(int(n.max(initial=0))):
            live = int(np.searchsorted(-n[by], -j, side="left"))
            at = at[:live]
            out.append((at, by[:live], np.full(live, j)))
            at = self.psi[at]
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, dtype=np.int64) for k in range(3))


def merge(shards: list[Shard], counts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shard, string, offset, interval) of the first counts[s][u] suffixes of every string, all of `width` symbols at least.

    Two suffixes have the same interval if and only if their first `width` symbols are equal.
    """
    words, skips, rows, owner, string, offset, own = [], [], [], [], [], [], []
    base, kinds = 0, 0
    for s, (shard, n) in enumerate(zip(shards, counts, strict=True)):
        walk = Walk(shard)
        at, u, o = walk.places(shard.starts, n)
        by = np.argsort(at)
        at, u, o = at[by], u[by], o[by]
        kind = np.cumsum(~shard.same)[at]  # equal within the shard
        own.append(kind + kinds)
        kinds += int(kind[-1]) + 1 if len(kind) else 0
        words.append(walk.word)
        skips.append(walk.skip + np.int32(base))
        rows.append(at.astype(np.int64) + base)
        owner.append(np.full(len(at), s))
        string.append(u)
        offset.append(o)
        base += len(shard.bwt)
    word, skip, cur, owner, string, offset, own = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (words, skips, rows, owner, string, offset, own))
    interval = own.copy()  # of settled suffixes; those that stay mixed get numbers of their own
    live = np.arange(len(cur))
    block = np.zeros(len(cur), dtype=np.int64)
    for depth in range(0, width, STEP):
        if not len(live):
            break
        new = np.ones(len(live), dtype=bool)
        new[1:] = block[1:] != block[:-1]
        head = np.flatnonzero(new)
        who = owner[live]
        mixed = np.minimum.reduceat(who, head) != np.maximum.reduceat(who, head)
        keep = np.repeat(mixed, np.diff(np.append(head, len(live))))
        live, cur, block = live[keep], cur[keep], block[keep]
        beyond = max(0, depth + STEP - width)
        key = word[cur] >> (SYMBOL * beyond)
        by = np.argsort(key)
        if depth:  # by block, then by key
            new = np.ones(len(by), dtype=bool)
            new[1:] = key[by[1:]] != key[by[:-1]]
            dense = np.empty(len(by), dtype=np.int64)
            dense[by] = np.cumsum(new)
            by = np.argsort(block * (len(by) + 1) + dense)
        live, cur, block, key = live[by], skip[cur[by]], block[by], key[by]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (block[1:] != block[:-1]) | (key[1:] != key[:-1])
        block = np.cumsum(new)
    if len(live):
        interval[live] = kinds + block
    return owner, string, offset, interval
