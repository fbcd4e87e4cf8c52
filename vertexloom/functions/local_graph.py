"""Array kernels for a graph that fits one task: the same results as the supersteps, for sizes below a fixed bound.

``n`` is the size of the dense id domain; ``src`` and ``dst`` are the arcs in the direction messages take.
"""

from __future__ import annotations

import numpy as np


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the components of these links: every vertex with its component's smallest id; vertices without links with their own."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        low = label.copy()
        np.minimum.at(low, x, y)
        np.minimum.at(low, y, x)
        while True:  # labels of labels
            higher = low[low]
            if (higher == low).all():
                break
            low = higher
        label = low[label]
        x, y = low[x], low[y]
        keep = x != y
        x, y = x[keep], y[keep]
    return ids, ids[label]


class Arcs:
    """Arcs grouped by their source."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None = None):
        order = np.argsort(src, kind="stable")
        self.dst, self.weight = dst[order], None if weight is None else weight[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])

    def of(self, frontier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the arcs that leave the frontier, and the vertex each leaves."""
        first, count = self.start[frontier], self.start[frontier + 1] - self.start[frontier]
        ends = np.cumsum(count)
        return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0), np.repeat(frontier, count)


def levels(n: int, src: np.ndarray, dst: np.ndarray, root: int) -> np.ndarray:
    """Hops from the root; -1 where it doesn't reach."""
    arcs, level, frontier, hop = Arcs(n, src, dst), np.full(n, -1, np.int64), np.array([root]), 0
    level[root] = 0
    while len(frontier):
        hop += 1
        at, _ = arcs.of(frontier)
        reached = np.unique(arcs.dst[at])
        frontier = reached[level[reached] < 0]
        level[frontier] = hop
    return level


def distances(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, source: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances (infinite where the source doesn't reach) and predecessors (-1: none), by the supersteps' rules."""
    arcs, value, pred, frontier = Arcs(n, src, dst, weight), np.full(n, np.inf), np.full(n, -1, np.int64), np.array([source])
    value[source] = 0
    for _ in range(n + 1):
        at, sender = arcs.of(frontier)
        to, cost = arcs.dst[at], value[sender] + arcs.weight[at]
        order = np.lexsort((sender, cost, to))
        to, cost, sender = to[order], cost[order], sender[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, np.int64)
        to, cost, sender = to[first], cost[first], sender[first]
        with np.errstate(invalid="ignore"):
            better = (cost < value[to]) & ~(np.abs(cost - value[to]) < epsilon)
        frontier = to[better]
        value[frontier], pred[frontier] = cost[better], sender[better]
        if not len(frontier):
            return value, pred
    raise ValueError("sssp does not converge: is there a cycle of negative weight?")


def ranks(n: int, src: np.ndarray, dst: np.ndarray, iterations: int, damping: float, per_edge: float) -> np.ndarray:
    out, rank = np.bincount(src, minlength=n), np.ones(n)
    for _ in range(iterations):
        rank = rank + np.bincount(dst, weights=damping * (rank[src] / out[src]) + per_edge, minlength=n)
    return rank


def smallest_reaching(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest id that reaches each vertex."""
    arcs, colour, frontier = Arcs(n, src, dst), np.arange(n), np.unique(src)
    while len(frontier):
        at, sender = arcs.of(frontier)
        low = colour.copy()
        np.minimum.at(low, arcs.dst[at], colour[sender])
        frontier = np.flatnonzero(low < colour)
        colour = low
    return colour


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest id of each vertex's strong component, by colouring forward and searching backward within a colour."""
    label, keep = np.arange(n), src != dst
    src, dst = src[keep], dst[keep]
    while len(src):
        while True:  # vertices that nothing enters or nothing leaves are components of their own
            inner = np.isin(src, dst) & np.isin(dst, src)
            if inner.all():
                break
            src, dst = src[inner], dst[inner]
        if not len(src):
            break
        colour = smallest_reaching(n, src, dst)
        same = colour[src] == colour[dst]
        src, dst = src[same], dst[same]
        back, found = Arcs(n, dst, src), np.zeros(n, bool)
        frontier = np.unique(src)
        frontier = frontier[colour[frontier] == frontier]
        while len(frontier):
            found[frontier] = True
            at, _ = back.of(frontier)
            reached = np.unique(back.dst[at])
            frontier = reached[~found[reached]]
        label[found] = colour[found]
        left = ~found[src] & ~found[dst]
        src, dst = src[left], dst[left]
    return label
