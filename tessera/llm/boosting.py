"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees: a leaf has feature -1 and its value; else value <= threshold goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values for each row, one array step a level."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(inner, np.where(go, self.left[node], self.right[node]), node)
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 20, ridge: float = 1.0) -> Forest:
    """monotone: for each feature 1 (a larger value never lowers the result), -1 (never raises it) or 0."""
    nodes: list[list[float]] = []
    roots: list[int] = []
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    if len(y) == 0 or y.min() == y.max():
        trees = 0
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if trees else []
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1) if trees else x
    margin = np.full(len(y), bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-sum_g / (sum_h + ridge), low, high))
        nodes.append([-1, 0.0, at, at, rate * value])
        if level == depth or len(rows) < 2 * least:
            return at
        best = (1e-6, -1, -1, 0.0)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, weights=v, minlength=len(c) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
            vl, vr = -gl / (hl + ridge), -(sum_g - gl) / (sum_h - hl + ridge)
            gain = gl**2 / (hl + ridge) + (sum_g - gl) ** 2 / (sum_h - hl + ridge) - sum_g**2 / (sum_h + ridge)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            if monotone[f]:
                gain[(np.clip(vr, low, high) - np.clip(vl, low, high)) * monotone[f] < 0] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float((np.clip(vl[k], low, high) + np.clip(vr[k], low, high)) / 2))
        _, f, k, middle = best
        if f < 0:
            return at
        go = binned[rows, f] <= k
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(monotone[f])]
        left = grow(rows[go], g, h, level + 1, *bounds[0])
        right = grow(rows[~go], g, h, level + 1, *bounds[1])
        nodes[at][:4] = [f, float(cuts[f][k]), left, right]
        return at

    forest = None
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        forest = flat(nodes, roots, depth, bias)
        one = Forest(forest.feature, forest.threshold, forest.left, forest.right, forest.value, np.array([first]), depth, 0.0)
        margin += one.margin(x)
    return forest or flat(nodes, roots, depth, bias)


def flat(nodes: list[list[float]], roots: list[int], depth: int, bias: float) -> Forest:
    a = np.array(nodes, float).reshape(-1, 5)
    return Forest(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots, np.int64), depth, bias)
