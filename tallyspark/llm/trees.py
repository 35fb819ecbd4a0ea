"""Binary decision trees over binned features, kept as flat arrays.

A tree of depth ``d`` is a heap: node ``k`` has children ``2k + 1`` and ``2k + 2``.  An ensemble is three
arrays ``(trees, nodes)``: feature, threshold, value; a row goes left where its feature is at most
the threshold.  A node that stays whole sends every row left (threshold +inf).  Traversal steps all rows through one
level at a time, so it is a handful of numpy gathers per level and tree.
"""

from __future__ import annotations

import numpy as np


class Forest:
    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, depth: int):
        self.feature, self.threshold, self.value, self.depth = feature, threshold, value, depth

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values for each row of ``x``."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node]
        return total


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner cut points per feature, at quantiles of its values."""
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: the cut points below the value, so that a cut ``e`` sends values <= e left."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int64)


def grow(binned: np.ndarray, edges: list[np.ndarray], bins: int, gradient: np.ndarray, weight: np.ndarray, depth: int,
         features: list[np.ndarray] | None, least: float, smooth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree by histograms: ``(feature, threshold, value, leaf of each row)``.

    The value of a leaf is sum(gradient) / (sum(weight) + smooth); a split maximises the summed
    squares of that.  ``features`` gives the candidates per level (all when None); both sides keep a
    weight of ``least``."""
    n, width = binned.shape
    nodes = 2 ** (depth + 1) - 1
    feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
    node = np.zeros(n, np.int64)
    for level in range(depth):
        base, many = 2**level - 1, 2**level
        g_all, w_all = np.bincount(node - base, gradient, many), np.bincount(node - base, weight, many)
        best, choice, cut = g_all**2 / (w_all + smooth) + 1e-9, np.full(many, -1), np.zeros(many, np.int64)
        for j in range(width) if features is None else features[level]:
            if not len(edges[j]):
                continue
            cell = (node - base) * bins + binned[:, j]
            g = np.bincount(cell, gradient, many * bins).reshape(many, bins).cumsum(axis=1)
            w = np.bincount(cell, weight, many * bins).reshape(many, bins).cumsum(axis=1)
            rest_g, rest_w = g_all[:, None] - g, w_all[:, None] - w
            gain = np.where((w >= least) & (rest_w >= least), g**2 / (w + smooth) + rest_g**2 / (rest_w + smooth), -np.inf)
            gain[:, len(edges[j]) :] = -np.inf
            at = gain.argmax(axis=1)
            top = gain[np.arange(many), at]
            better = top > best
            best[better], choice[better], cut[better] = top[better], j, at[better]
        for k in np.flatnonzero(choice >= 0):
            feature[base + k], threshold[base + k] = choice[k], edges[choice[k]][cut[k]]
        split = choice[node - base]
        right = (split >= 0) & (binned[np.arange(n), np.maximum(split, 0)] > cut[node - base])
        node = 2 * node + 1 + right
    value = np.bincount(node, gradient, nodes) / (np.bincount(node, weight, nodes) + smooth)
    return feature, threshold, value, node


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64) -> tuple[Forest, float]:
    """Histogram gradient boosting for the logistic loss; returns the trees and the constant before them."""
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    edges = bin_edges(x, bins)
    binned, margin, grown = to_bins(x, edges), np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        f, t, v, leaf = grow(binned, edges, bins, y - p, p * (1 - p), depth, None, least=1.0, smooth=1.0)
        margin += rate * v[leaf]
        grown.append((f, t, rate * v))
    f, t, v = (np.stack(part) for part in zip(*grown))
    return Forest(f, t, v, depth), start


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, bins: int = 64, seed: int = 7) -> Forest:
    """Bagged trees of class shares over random feature choices per level; the sums are the mean share."""
    draw = np.random.Generator(np.random.PCG64(seed))
    edges = bin_edges(x, bins)
    binned, grown, take = to_bins(x, edges), [], max(1, int(np.ceil(np.sqrt(x.shape[1])))) + 1
    for _ in range(trees):
        bag = np.bincount(draw.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        features = [draw.choice(x.shape[1], min(take, x.shape[1]), replace=False) for _ in range(depth)]
        f, t, v, _ = grow(binned, edges, bins, y * bag, bag, depth, features, least=2.0, smooth=1e-9)
        grown.append((f, t, v / trees))
    f, t, v = (np.stack(part) for part in zip(*grown))
    return Forest(f, t, v, depth)
