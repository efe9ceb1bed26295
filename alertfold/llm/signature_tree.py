"""Signature trees: links between similar sets without trying all pairs.

A leaf holds a few sets of about the same size, each with a bitmap of hashed elements. A node holds the OR of
its bitmaps and the range of its sizes. A pair of nodes is given up when no two of their sets can overlap
enough, or when all their sets are connected already; otherwise their children are paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

LEAF, FANOUT = 16, 4
_MAX_BITMAPS = 1 << 25
THRESHOLD = 75
"""Percent: two sets link when 100 * intersection >= THRESHOLD * union."""


def needed(sizes: np.ndarray | int) -> np.ndarray | int:
    """The overlap at which two sets of together ``sizes`` elements link."""
    return -(-THRESHOLD * sizes // (100 + THRESHOLD))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def bitmap_of(values: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits (a power of two, 64 at least) with a bit for each number, as 64-bit words."""
    out = np.zeros(bits // 8, np.uint8)
    slot = values.astype(np.uint64) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (slot >> np.uint64(3)).astype(np.int64), (1 << (slot & np.uint64(7))).astype(np.uint8))
    return out.view(np.uint64)


def exact(sets: Sequence[np.ndarray]) -> Callable[[int, int], bool]:
    """Whether two of these sets link."""

    def same(a: int, b: int) -> bool:
        common = overlap(sets[a], sets[b])
        return 100 * common >= THRESHOLD * (len(sets[a]) + len(sets[b]) - common)

    return same


class SignatureTree:
    """A tree over sets given by sizes and bitmaps (rows of 64-bit words).

    ``labels`` tells which are connected already. ``same`` decides on pairs whose bitmaps allow a link.
    """

    def __init__(self, size: np.ndarray, bitmap: np.ndarray, labels: np.ndarray, same: Callable[[int, int], bool]):
        self.order = np.lexsort((labels, size))
        self.same = same
        self.size, self.bitmap, self.label = size[self.order], bitmap[self.order], labels[self.order]
        self.excess = self.size - np.bitwise_count(self.bitmap).sum(axis=1).astype(np.int64)
        bitmap, excess, low, high = self.bitmap, self.excess, self.size, self.size
        # levels[0] are the leaves; node i covers the sets bound[i] to bound[i + 1]
        self.levels, bound, width = [], np.arange(len(size) + 1), LEAF
        while not self.levels or len(bound) > 2:
            at = np.arange(0, len(low), width)
            bitmap, excess = np.bitwise_or.reduceat(bitmap, at), np.maximum.reduceat(excess, at)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            bound = np.append(bound[at], bound[-1])
            self.levels.append((bitmap, excess, low, high, bound))
            width = FANOUT

    @classmethod
    def over(cls, sets: Sequence[np.ndarray], labels: np.ndarray) -> SignatureTree:
        """A tree that links sorted arrays of distinct numbers exactly."""
        size = np.array([len(s) for s in sets])
        bits = 64
        while bits < 2 * size.max() and 2 * bits * len(sets) <= 8 * _MAX_BITMAPS:
            bits *= 2
        return cls(size, np.stack([bitmap_of(s, bits) for s in sets]), labels, exact(sets))

    def _connected(self, level: int, a: int, b: int) -> bool:
        bound = self.levels[level][4]
        one, two = self.label[bound[a] : bound[a + 1]], self.label[bound[b] : bound[b + 1]]
        return bool((one == one[0]).all() and (two == one[0]).all())

    def _hopeless(self, level: int, a: int, b: int) -> bool:
        bitmap, excess, low, high, _ = self.levels[level]
        if 100 * min(high[a], high[b]) < THRESHOLD * max(low[a], low[b]):
            return True
        most = int(np.bitwise_count(bitmap[a] & bitmap[b]).sum()) + min(excess[a], excess[b])
        return bool(most < needed(low[a] + low[b]))

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that connect the sets as all links do: (index, index) of the sets as given."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, a, b = todo.pop()
            if self._connected(level, a, b) or (a != b and self._hopeless(level, a, b)):
                continue
            if level == 0:
                yield from self._leaves(a, b)
                continue
            below = len(self.levels[level - 1][2])
            left = range(a * FANOUT, min((a + 1) * FANOUT, below))
            right = range(b * FANOUT, min((b + 1) * FANOUT, below))
            pairs = [(x, y) for x in left for y in right if a != b or x <= y]
            # nodes with themselves first: what they connect saves the pairs between them
            todo += [(level - 1, x, y) for x, y in sorted(pairs, key=lambda p: p[0] == p[1])]

    def _leaves(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        bound = self.levels[0][4]
        one, two = np.arange(bound[a], bound[a + 1]), np.arange(bound[b], bound[b + 1])
        shared = np.bitwise_count(self.bitmap[one][:, None] & self.bitmap[two][None]).sum(axis=2)
        most = shared + np.minimum(self.excess[one][:, None], self.excess[two][None])
        both = self.size[one][:, None] + self.size[two][None]
        hopeful = (most >= needed(both)) & (self.label[one][:, None] != self.label[two][None])
        hopeful &= 100 * np.minimum(self.size[one][:, None], self.size[two][None]) >= THRESHOLD * np.maximum(
            self.size[one][:, None], self.size[two][None]
        )
        for x, y in zip(*np.nonzero(hopeful)):
            i, j = one[x], two[y]
            if (a != b or i < j) and self.label[i] != self.label[j]:
                if self.same(int(self.order[i]), int(self.order[j])):
                    self.label[self.label == self.label[j]] = self.label[i]
                    yield int(self.order[i]), int(self.order[j])
