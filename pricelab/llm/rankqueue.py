"""Byte-pair merges of many pre-tokens at once over a hierarchical-bitmap rank queue.

All symbols of all pre-tokens stand in one linked list that has no links
between pre-tokens.  One bucket per merge rank holds the positions where that
merge was possible when they were queued.  A bitmap over the ranks, with
64-way summary levels above it, says which buckets are filled; find-first-set
on each level picks the lowest rank.  A popped bucket is merged as a whole:
stale positions (whose pair has changed) are skipped, and of overlapping ones
in a row ("aaa") the leftmost goes first, then every second.  Each merge
queues its two new pairs.  So the work follows the number of merges, however
long a pre-token is.
"""
from __future__ import annotations

import numpy as np


class RankQueue:
    """Arrays of positions by merge rank; pop() gives the lowest rank and its positions."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels: list[list[int]] = []
        while True:
            n_ranks = (n_ranks + 63) >> 6
            self.levels.append([0] * n_ranks)
            if n_ranks <= 1:
                break

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word = rank >> 6
            was = level[word]
            level[word] = was | 1 << (rank & 63)
            if was:
                break
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Queue every position under its rank; negative ranks (no merge) are left out."""
        ok = ranks >= 0
        ranks, positions = ranks[ok], positions[ok]
        if not len(ranks):
            return
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        ends = [*starts[1:], len(ranks)]
        for r, i, j in zip(ranks[starts].tolist(), starts, ends):
            self.push(r, positions[i:j])

    def pop(self) -> tuple[int, np.ndarray] | None:
        levels = self.levels
        if not levels[-1] or not levels[-1][0]:
            return None
        rank = 0
        for level in reversed(levels):
            bits = level[rank]
            rank = rank << 6 | (bits & -bits).bit_length() - 1
        at = rank
        for level in levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Merger:
    """Merge rules: ``rules`` maps (left symbol, right symbol) to the merge's rank, and
    the merged symbol is ``merged[rank]``.  Symbols are ints from 0; -1 merges with nothing."""

    def __init__(self, rules: dict[tuple[int, int], int], merged: np.ndarray):
        pairs = np.array(list(rules), np.int64).reshape(-1, 2)
        ranks = np.fromiter(rules.values(), np.int64, len(rules))
        self.merged = np.asarray(merged, np.int64)
        self.width = int(max(pairs.max(initial=0), self.merged.max(initial=0))) + 2
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], 2**62), np.append(ranks[order], -1)
        self.queue = RankQueue(len(self.merged) + 1)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, left * self.width + right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge pre-tokens given one after another as ``symbols`` with ``lengths`` (none 0).

        Returns the remaining symbols, each pre-token's number of them, and
        the positions of pre-tokens for which the order of merges of one rank
        matters (a merge opened one of a lower rank): those are to be redone
        one by one.  Ordinary vocabularies give none or few.
        """
        n = len(symbols)
        sym = symbols.astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        nxt = np.arange(1, n + 1)
        nxt[np.cumsum(lengths) - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[np.cumsum(lengths) - lengths] = -1
        alive = np.ones(n, bool)
        redo = np.zeros(len(lengths), bool)
        pair = np.full(n, -1, np.int64)
        at = np.flatnonzero(nxt >= 0)
        pair[at] = self.rank_of(sym[at], sym[at + 1])
        queue, merged = self.queue, self.merged
        queue.push_all(pair[at], at)
        while (top := queue.pop()) is not None:
            rank, pos = top
            pos = pos[pair[pos] == rank]                       # the rest is stale
            if not len(pos):
                continue
            if len(pos) > 1:
                pos = np.unique(pos)
                follows = nxt[pos[:-1]] == pos[1:]
                if follows.any():                              # overlapping in a row: every second
                    first = np.flatnonzero(np.concatenate([[True], ~follows]))
                    run = np.repeat(first, np.diff(np.append(first, len(pos))))
                    pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            gone = nxt[pos]
            end = nxt[gone]
            new = int(merged[rank])
            has = end >= 0
            if len(pos) > 1:                                   # what a merge opens before its right neighbour merges too
                e = end[has]
                between = self.rank_of(np.full(len(e), new), sym[e])
                low = (between >= 0) & (between < rank)
                redo[owner[pos[has][low]]] = True
            sym[pos] = new
            nxt[pos] = end
            prv[end[has]] = pos[has]
            alive[gone] = False
            pair[gone] = -1
            back = prv[pos]
            back = back[back >= 0]
            left = np.concatenate([pos, back]) if len(back) else pos
            right = nxt[left]
            ranks = np.full(len(left), -1, np.int64)
            ok = right >= 0
            ranks[ok] = self.rank_of(sym[left[ok]], sym[right[ok]])
            low = (ranks >= 0) & (ranks < rank)
            if low.any():
                redo[owner[left[low]]] = True
            pair[left] = ranks
            queue.push_all(ranks, left)
        counts = np.bincount(owner[alive], minlength=len(lengths))
        return sym[alive], counts, np.flatnonzero(redo & (lengths > 3))


class Recent:
    """Remembers a bounded number of results, in two generations."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys) -> list:
        """Keys not remembered; those of the older generation are moved to the newer."""
        new, old = self.new, self.old
        out = []
        for k in keys:
            if k not in new:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    new[k] = v
        return out

    def turn(self) -> None:
        """To be called between batches: a full generation becomes the older one."""
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
