"""Cover trees over many small sets of integer points at once, and nearest centres of whole subtrees.

Level by level the points of a node are split among children whose centres lie further apart than half the reach
of the level; the first child keeps the node's own centre. Points of a node stand next to each other, so that
the sum of any subtree is a difference of two running sums. Squared distances are exact integers; a square root
only ever rules centres out, with room for its rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 8


@dataclass
class Forest:
    """Trees over ``points``, which are in tree order, one per set. Node arrays run over all trees; the first ones are the roots.

    Node v holds the points ``low[v]:high[v]``. The first is its centre, from which none is further than the root of
    ``reach[v]``. Its children are ``child[v]:child[v] + children[v]``. ``original`` gives a point's place before.
    """

    points: np.ndarray
    original: np.ndarray
    low: np.ndarray
    high: np.ndarray
    reach: np.ndarray
    child: np.ndarray
    children: np.ndarray
    sets: int

    FIELDS = ("points", "original", "low", "high", "reach", "child", "children")


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    difference = a - b
    return np.einsum("ij,ij->i", difference, difference)


def _split(points: np.ndarray, node: np.ndarray, centre: np.ndarray, reach: int) -> np.ndarray:
    """Children of nodes: for each point (in order of ``node``) the place of its child's centre among the points.

    ``centre`` is that of the point's node. A point goes to the first child whose squared distance is at most
    ``reach``; where there is none, the first point left of each node is the next child's centre.
    """
    owner = np.where(_squared(points, points[centre]) <= reach, centre, -1)
    left = np.flatnonzero(owner < 0)
    while len(left):
        new = np.append(True, np.diff(node[left]) != 0)
        chosen = left[new][np.cumsum(new) - 1]
        near = _squared(points[left], points[chosen]) <= reach
        owner[left[near]] = chosen[near]
        left = left[~near]
    return owner


def grow(sets: np.ndarray, leaf: int = LEAF) -> Forest:
    """A forest over ``sets`` of shape (sets, points, dimensions)."""
    count, size, width = sets.shape
    points = sets.reshape(-1, width).astype(np.int64)
    original = np.arange(len(points))
    all_low, all_high = np.arange(count) * size, np.arange(1, count + 1) * size
    child, children, reach = (np.zeros(count, np.int64) for _ in range(3))
    nodes = count
    if len(points):
        reach = np.maximum.reduceat(_squared(points, points[np.repeat(all_low, size)]), all_low)
    level = int(reach.max(initial=0))
    active = np.flatnonzero((reach > 0) & (all_high - all_low > leaf))
    while len(active):
        level //= 4
        spans = all_high[active] - all_low[active]
        place = np.repeat(all_low[active] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
        begin = np.repeat(np.cumsum(spans) - spans, spans)
        part = np.repeat(np.arange(len(active)), spans)
        owner = _split(points[place], part, begin, level)
        # children in the order of their centres, each centre first
        order = np.lexsort((np.arange(len(owner)) != owner, owner, part))
        first = np.append(True, np.diff(owner[order]) != 0)
        points[place], original[place] = points[place][order], original[place][order]
        head = np.flatnonzero(first)
        span = np.diff(np.append(head, len(order)))
        parent = part[head]
        family = np.bincount(parent, minlength=len(active))
        several = family > 1
        # a node with a single child stays as it is until a later level divides it
        made = several[parent]
        numbers = nodes + np.arange(int(made.sum()))
        child[active[several]] = numbers[np.append(True, np.diff(parent[made]) != 0)] if made.any() else numbers
        children[active[several]] = family[several]
        new_low, new_span = place[head[made]], span[made]
        new_place = np.repeat(new_low - (np.cumsum(new_span) - new_span), new_span) + np.arange(int(new_span.sum()))
        to_centre = _squared(points[new_place], points[np.repeat(new_low, new_span)])
        new_far = np.maximum.reduceat(to_centre, np.cumsum(new_span) - new_span) if len(new_span) else new_span
        all_low, all_high = np.append(all_low, new_low), np.append(all_high, new_low + new_span)
        reach = np.append(reach, new_far)
        child, children = (np.append(a, np.zeros(len(numbers), np.int64)) for a in (child, children))
        nodes += len(numbers)
        active = np.concatenate([active[~several], numbers[(new_far > 0) & (new_span > leaf)]])
    return Forest(points, original, all_low, all_high, reach, child, children, count)


def _pairs(lists: np.ndarray, counts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items that look at the list of owner ``of``: (item, entry) pairs. Lists stand behind each other."""
    begin = np.cumsum(counts) - counts
    n = counts[of]
    item = np.repeat(np.arange(len(of)), n)
    return item, lists[np.repeat(begin[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _nearest(item: np.ndarray, entry: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item (all have pairs, in order) the first entry of smallest distance, and that distance."""
    first = np.flatnonzero(np.append(True, np.diff(item) != 0))
    least = np.minimum.reduceat(distance, first)
    tied = np.where(distance == least[item], entry, np.iinfo(np.int64).max)
    return np.minimum.reduceat(tied, first), least


def assign(forest: Forest, centres: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Nearest centre of every point; ``centres`` has shape (sets, centres, dimensions), ties go to the lower one.

    Gives whole subtrees as (nodes, centre numbers), list by list, and single points as (places, centre numbers).
    A centre stays a candidate of a subtree as long as it may be nearest to, or as near as any to, one of its points.
    """
    size = centres.shape[1]
    flat = centres.reshape(-1, centres.shape[2])
    set_of_root = np.arange(forest.sets)
    nodes = np.flatnonzero(forest.high[: forest.sets] > forest.low[: forest.sets])
    owner_set = set_of_root[nodes]
    item = np.repeat(np.arange(len(nodes)), size)
    entry = np.tile(np.arange(size), len(nodes))
    whole: list[tuple[np.ndarray, np.ndarray]] = []
    places: list[np.ndarray] = [np.zeros(0, np.int64)]
    chosen: list[np.ndarray] = [np.zeros(0, np.int64)]
    while len(nodes):
        distance = _squared(forest.points[forest.low[nodes]][item], flat[owner_set[item] * size + entry])
        best, least = _nearest(item, entry, distance)
        radius = np.sqrt(forest.reach[nodes].astype(np.float64))
        bound = np.sqrt(least.astype(np.float64)) + 2 * radius
        bound *= 1 + 1e-9
        keep = distance <= bound[item] ** 2 + 1e-6
        counts = np.bincount(item[keep], minlength=len(nodes))
        done = (counts == 1) | (forest.reach[nodes] == 0)
        whole.append((nodes[done], best[done]))
        leaf = ~done & (forest.children[nodes] == 0)
        inner = ~done & ~leaf
        lists = entry[keep]
        if leaf.any():
            of = np.flatnonzero(leaf)
            span = forest.high[nodes[of]] - forest.low[nodes[of]]
            place = np.repeat(forest.low[nodes[of]] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
            owner = np.repeat(of, span)
            point, candidate = _pairs(lists, counts, owner)
            exact = _squared(forest.points[place][point], flat[owner_set[owner][point] * size + candidate])
            places.append(place)
            chosen.append(_nearest(point, candidate, exact)[0])
        of = np.flatnonzero(inner)
        family = forest.children[nodes[of]]
        below = np.repeat(forest.child[nodes[of]] - (np.cumsum(family) - family), family) + np.arange(int(family.sum()))
        owner = np.repeat(of, family)
        item, entry = _pairs(lists, counts, owner)
        nodes, owner_set = below, owner_set[owner]
    return whole, (np.concatenate(places), np.concatenate(chosen))


def labels(forest: Forest, centres: np.ndarray) -> np.ndarray:
    """Centre number of every point, in the original order."""
    whole, (places, chosen) = assign(forest, centres)
    out = np.empty(len(forest.points), np.int64)
    for nodes, numbers in whole:
        span = forest.high[nodes] - forest.low[nodes]
        place = np.repeat(forest.low[nodes] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        out[place] = np.repeat(numbers, span)
    out[places] = chosen
    back = np.empty_like(out)
    back[forest.original] = out
    return back


def sums(forest: Forest, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per set and centre: the sum of its points and their number. A subtree counts by its running sums."""
    sets, size, width = centres.shape
    running = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(forest.points, axis=0)])
    set_size = len(forest.points) // sets if sets else 0
    total, count = np.zeros((sets * size, width), np.int64), np.zeros(sets * size, np.int64)
    whole, (places, chosen) = assign(forest, centres)
    for nodes, numbers in whole:
        slot = forest.low[nodes] // max(1, set_size) * size + numbers
        np.add.at(total, slot, running[forest.high[nodes]] - running[forest.low[nodes]])
        np.add.at(count, slot, forest.high[nodes] - forest.low[nodes])
    slot = places // max(1, set_size) * size + chosen
    np.add.at(total, slot, forest.points[places])
    np.add.at(count, slot, 1)
    return total.reshape(sets, size, width), count.reshape(sets, size)
