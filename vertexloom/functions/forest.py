"""Array kernels on one partition's piece of a forest.

A node is ``(id, parent, w, m, root, base)``: if the parent can be resolved, the node's root is the parent's and its depth is
``w`` plus the parent's; else its root is ``root`` and its depth ``base`` (-1: on or behind a closed loop, ``root`` then is
the loop's smallest id). ``m`` is the smallest original id that the step from ``id`` to ``parent`` passes, ``id`` included.
"""

from __future__ import annotations

import numpy as np

FIELDS = ("id", "parent", "w", "m", "root", "base")
NONE = np.iinfo(np.int64).min
_HIGH = np.iinfo(np.int64).max


def local_parents(ids: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Positions of the parents in sorted ``ids``; -1 where the parent isn't here."""
    if not len(ids):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(ids, parent), len(ids) - 1)
    return np.where((ids[at] == parent) & (parent != NONE), at, -1)


def contract(node: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Follow every chain to its exit from the partition by pointer doubling; solve loops that are closed in it."""
    order = np.argsort(node["id"], kind="stable")
    n = {k: v[order] for k, v in node.items()}
    up = local_parents(n["id"], n["parent"])
    inner = up >= 0
    jump = np.where(inner, up, np.arange(len(up)))
    dist, low = np.where(inner, n["w"], 0), np.where(inner, n["m"], _HIGH)
    with np.errstate(over="ignore"):
        for _ in range(max(1, int(len(up)).bit_length())):
            if not inner[jump].any():
                break
            dist, low, jump = dist + dist[jump], np.minimum(low, low[jump]), jump[jump]
    looped = inner[jump]
    base = n["base"][jump]
    return {
        "id": n["id"],
        "parent": np.where(looped, NONE, n["parent"][jump]),
        "w": np.where(looped, 0, dist + n["w"][jump]),
        "m": np.minimum(low, n["m"][jump]),
        "root": np.where(looped, low[jump], n["root"][jump]),
        "base": np.where(looped | (base < 0), -1, base + dist),
    }


def subtree_sums(ids: np.ndarray, parent: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and, for each, the weight of itself and of all below it in this partition. The forest has no loops."""
    order = np.argsort(ids, kind="stable")
    ids, parent, total = ids[order], parent[order], weight[order].copy()
    up = local_parents(ids, parent)
    jump, hops = np.where(up >= 0, up, np.arange(len(up))), (up >= 0).astype(np.int64)
    while hops[jump].any():
        hops, jump = hops + hops[jump], jump[jump]
    by_depth = np.argsort(-hops, kind="stable")
    ends = np.flatnonzero(np.diff(hops[by_depth])) + 1
    for level in np.split(by_depth, ends):
        level = level[up[level] >= 0]
        np.add.at(total, up[level], total[level])
    return ids, total
