"""Longest common extensions of positions in a sequence, after a suffix sort of a difference cover.

Of every COVER positions only those whose remainder lies in RESIDUES are sorted by their suffixes. Any two
positions reach two sorted ones within COVER - 1 equal steps, because every difference of remainders occurs
between two of RESIDUES; what follows there is the smallest of a range of neighbouring common prefixes, read from
a sparse table. All work is done on arrays of positions.
"""

from __future__ import annotations

import numpy as np

COVER = 13
RESIDUES = np.array([0, 1, 3, 9])
"""Fixed values: every non-zero remainder modulo 13 is a difference of exactly one pair of these."""

_PLACE = np.full(COVER, -1)
_PLACE[RESIDUES] = np.arange(len(RESIDUES))
_MEET = np.array([next(x for x in RESIDUES if _PLACE[(x + d) % COVER] >= 0) for d in range(COVER)])
"""For a difference of two positions the remainder at which both, moved on together, are sorted."""


def _dense(order: np.ndarray, changes: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.append(0, np.cumsum(changes))
    return rank


class CommonExtension:
    """``lengths(i, j)``: how many symbols from i on equal those from j on, for arrays of positions i < j.

    ``symbols`` are integers from 0 on. The last one must occur nowhere else, so that a suffix never ends inside
    another.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        blocks = len(symbols) // COVER + 2
        beyond = int(symbols.max()) + 1 + np.arange(blocks * COVER - len(symbols))
        self.symbols = np.concatenate([symbols, beyond]).astype(np.int64)
        self._sort((blocks - 1) * len(RESIDUES))

    def _sort(self, count: int) -> None:
        """Rank the sampled suffixes by doubling, from COVER symbols on; keep the ranks of every round."""
        sampled = (np.arange(count // len(RESIDUES))[:, None] * COVER + RESIDUES).ravel()
        bits = int(self.symbols.max()).bit_length()
        together = max(1, 63 // bits)
        keys = []
        for low in range(0, COVER, together):
            key = np.zeros(count, np.int64)
            for step in range(low, min(low + together, COVER)):
                key = (key << bits) | self.symbols[sampled + step]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        changes = np.zeros(count - 1, bool)
        for key in keys:
            changes |= np.diff(key[order]) != 0
        rounds = [_dense(order, changes)]
        while rounds[-1].max() < count - 1:
            step = len(RESIDUES) << (len(rounds) - 1)
            rank = rounds[-1]
            key = rank * (count + 1)
            key[: max(0, count - step)] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            rounds.append(_dense(order, np.diff(key[order]) != 0))
        self.rank = rounds[-1]
        self._neighbours(sampled, order, rounds[:-1])

    def _neighbours(self, sampled: np.ndarray, order: np.ndarray, rounds: list[np.ndarray]) -> None:
        """Common prefixes of suffixes next to each other in sorted order, and the sparse table over them."""
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(a), np.int64)
        for power in range(len(rounds) - 1, -1, -1):
            inside = np.maximum(a, b) < len(order)
            same = inside.copy()
            same[inside] = rounds[power][a[inside]] == rounds[power][b[inside]]
            shared[same] += COVER << power
            a[same] += len(RESIDUES) << power
            b[same] += len(RESIDUES) << power
        i, j = sampled[order[:-1]] + shared, sampled[order[1:]] + shared
        left = np.arange(len(i))
        for _ in range(COVER):  # what is left is shorter than a block
            left = left[np.maximum(i[left], j[left]) < len(self.symbols)]
            left = left[self.symbols[i[left]] == self.symbols[j[left]]]
            shared[left] += 1
            i[left] += 1
            j[left] += 1
        self.table = [shared]
        while 2 << (len(self.table) - 1) <= len(shared):
            half = 1 << (len(self.table) - 1)
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extensions of sorted positions."""
        at = [self.rank[(p // COVER) * len(RESIDUES) + _PLACE[p % COVER]] for p in (i, j)]
        low, high = np.minimum(*at), np.maximum(*at)
        power = np.frexp(high - low)[1] - 1
        out = np.empty(len(i), np.int64)
        for p in np.unique(power):
            some = power == p
            row = self.table[p]
            out[some] = np.minimum(row[low[some]], row[high[some] - (1 << int(p))])
        return out

    def lengths(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        steps = (_MEET[(j - i) % COVER] - i) % COVER
        out = np.zeros(len(i), np.int64)
        left = np.arange(len(i))
        for step in range(COVER):
            met = left[steps[left] == step]
            if len(met):
                out[met] = step + self._sampled(i[met] + step, j[met] + step)
                left = left[steps[left] != step]
            left = left[self.symbols[i[left] + step] == self.symbols[j[left] + step]]
            out[left] = step + 1
            if not len(left):
                break
        return out
