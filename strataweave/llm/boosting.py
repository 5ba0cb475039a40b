"""Gradient-boosted trees for a yes-no question, in numpy; small, exact and repeatable."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth on binned features, fitted to the logistic loss; scores are calibrated by Platt's line."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], 1)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        z = np.full(len(y), self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-z))
            tree, leaf = self._tree(b, y - p, p * (1 - p))
            self.trees.append(tree)
            z += tree[2][leaf]
        return self

    def _tree(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64)
        node = np.zeros(len(b), np.int64)
        for level in range(self.depth):
            first = (1 << level) - 1
            best = np.zeros(1 << level)
            for f in range(b.shape[1]):
                at = (node - first) * (self.bins + 1) + b[:, f]
                shape = (1 << level, self.bins + 1)
                g = np.bincount(at, grad, shape[0] * shape[1]).reshape(shape).cumsum(1)
                h = np.bincount(at, hess, shape[0] * shape[1]).reshape(shape).cumsum(1)
                gain = g**2 / (h + self.ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                k = gain[:, :-1].argmax(1)
                value = gain[np.arange(len(k)), k]
                better = value > best + 1e-9
                best[better] = value[better]
                feature[first : first + len(k)][better] = f
                cut[first : first + len(k)][better] = k[better]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - inner
        leaves = 1 << self.depth
        value = self.rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + self.ridge)
        return (feature, cut, value), leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)
        z = np.full(len(x), self.start)
        at = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[at, feature[node]] > cut[node])
            z += value[node - (len(feature))]
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt's line on rows that the fit didn't see, by Newton steps."""
        z = self.raw(x)
        w = np.array([1.0, 0.0])
        d = np.stack([z, np.ones(len(z))], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            g = d.T @ (y - p) - 0.01 * (w - np.array([1.0, 0.0]))
            h = (d * (p * (1 - p))[:, None]).T @ d + 0.01 * np.eye(2)
            w = w + np.linalg.solve(h, g)
        self.slope, self.shift = map(float, w)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))
