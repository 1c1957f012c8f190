"""BK-trees over bit codes, many at once: built and searched level by level in NumPy."""

from __future__ import annotations

import numpy as np

from .arrow import ranges

#: Rows of a leaf, rows of a tile, and what reaches in single precision may be off.
LEAF, TILE, SLACK = 4096, 256, 1e-4


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Hamming distance of the rows of two matrices of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """One BK-tree for each shard of ``codes`` (rows of 64-bit words).

    The first row of a shard is its root; the children of a node are keyed by their integer Hamming distance to it. All
    trees grow together: in each round, the rows that have not found a place move on to the child of their node at their
    distance, or become it.
    """

    def __init__(self, codes: np.ndarray, shards: np.ndarray):
        n, self.codes = len(codes), codes
        self.width = 64 * codes.shape[1] + 1
        names, first = np.unique(shards, return_index=True)
        self.names, self.roots = names, first
        node = first[np.searchsorted(names, shards)]
        waiting = np.nonzero(node != np.arange(n))[0]
        edges, children = [], []
        while len(waiting):
            at = node[waiting] * self.width + hamming(codes[waiting], codes[node[waiting]])
            edge, child = np.unique(at, return_index=True)
            edges.append(edge)
            children.append(waiting[child])
            node[waiting] = waiting[child][np.searchsorted(edge, at)]
            waiting = waiting[node[waiting] != waiting]
        edges, children = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, children))
        order = np.argsort(edges, kind="stable")
        self.edges, self.children = edges[order], children[order]

    def search(self, codes: np.ndarray, shards: np.ndarray, radius: np.ndarray, *, most: int = 100_000):
        """Pairs (query, row) within each query's radius in the tree of its shard, in blocks; only edges within the radius of a node's distance are followed."""
        root = np.searchsorted(self.names, shards)
        known = (root < len(self.names)) & (self.names[np.minimum(root, len(self.names) - 1)] == shards) if len(self.names) else np.zeros(len(shards), bool)
        query = np.nonzero(known)[0]
        stack = [(query, self.roots[root[query]])]
        while stack:
            q, node = stack.pop()
            if len(q) > most:
                stack += [(q[a : a + most], node[a : a + most]) for a in range(0, len(q), most)]
                continue
            d = hamming(codes[q], self.codes[node])
            near = d <= radius[q]
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.edges, node * self.width + np.maximum(d - radius[q], 0), "left")
            high = np.searchsorted(self.edges, node * self.width + np.minimum(d + radius[q], self.width - 1), "right")
            owner, at = ranges(low, high)
            if len(owner):
                stack.append((q[owner], self.children[at]))


def _within(codes: np.ndarray, reach: np.ndarray, a: np.ndarray, b: np.ndarray, ratio: float, own: bool):
    """Pairs of the rows ``a`` and ``b``, both by reach, that ``close_pairs`` asks for; ``own``: they are the same rows, and each two are compared once."""
    for lo in range(0, len(a), TILE):
        x = a[lo : lo + TILE]
        first = lo if own else int(np.searchsorted(reach[b], ratio * reach[x[0]] - SLACK, "left"))
        last = int(np.searchsorted(reach[b], (reach[x[-1]] + SLACK) / ratio, "right"))
        for low in range(first, last, 2 * TILE):
            y = b[low : min(low + 2 * TILE, last)]
            d = np.bitwise_count(codes[x, 0][:, None] ^ codes[y, 0][None, :])
            for word in range(1, codes.shape[1]):
                d = d + np.bitwise_count(codes[x, word][:, None] ^ codes[y, word][None, :])
            i, j = np.nonzero(d <= int(reach[x[-1]] + reach[y[-1]] + SLACK))
            fit = fits(d[i, j], reach[x[i]], reach[y[j]], ratio)
            if own and low < lo + TILE:
                fit &= lo + i < low + j
            if fit.any():
                yield x[i[fit]], y[j[fit]]


def fits(d: np.ndarray, a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    return (d <= a + b + SLACK) & (np.minimum(a, b) >= ratio * np.maximum(a, b) - SLACK)


def close_pairs(codes: np.ndarray, reach: np.ndarray, rows: np.ndarray, *, ratio: float = 0.75, leaf: int = LEAF):
    """Every two of ``rows`` (numbers, by reach) whose codes lie within the sum of their ``reach``, the smaller being at least ``ratio`` of the larger.

    They stand in a BK-tree whose nodes of up to ``leaf`` rows are leaves. A larger node has its first row as the root and children by their integer distance to it; a child is only joined with those whose
    distance differs by no more than the largest radius. Leaves, and children that have to be joined, are compared by tiles: unrelated codes lie at
    so much the same distance from one another that a tree down to single rows visits nearly all pairs all the same, at twenty times the cost of each.
    """
    if len(rows) <= leaf:
        yield from _within(codes, reach, rows, rows, ratio, True)
        return
    d = hamming(codes[rows], codes[rows[0]][None, :])
    order = np.argsort(d, kind="stable")
    level, first = np.unique(d[order], return_index=True)
    end, radius = np.append(first[1:], len(rows)), int(2 * reach[rows].max() + SLACK)
    for k, at in enumerate(level.tolist()):
        child = rows[order[first[k] : end[k]]]
        if len(child) < len(rows):
            yield from close_pairs(codes, reach, child, ratio=ratio, leaf=leaf)
        else:  # copies of the root, which no distance can tell apart
            yield from _within(codes, reach, child, child, ratio, True)
        others = rows[np.sort(order[end[k] : end[np.searchsorted(level, at + radius, "right") - 1]])]
        if len(others):
            yield from _within(codes, reach, child, others, ratio, False)
