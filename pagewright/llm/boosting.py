"""Gradient-boosted regression trees for a logistic loss, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of one depth, kept as arrays: node k has children 2k+1 and 2k+2; a node without gain sends all rows left."""

    def __init__(self, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.2, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.bins, self.rate, self.ridge = trees, depth, bins, rate, ridge
        self.edges: list[np.ndarray] = []
        self.feature = np.zeros((0, 2**depth - 1), np.int64)
        self.split = np.zeros((0, 2**depth - 1), np.int64)
        self.leaf = np.zeros((0, 2**depth))
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def _leaves(self, binned: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > split[node])
        return node - (2**self.depth - 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = self._binned(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), self.base)
        features, splits, leaves = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            gradient, weight = y - p, p * (1 - p)
            feature, split = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-6)
                for k in range(x.shape[1]):
                    at = (node - first) * self.bins + binned[:, k]
                    g = np.cumsum(np.bincount(at, gradient, n * self.bins).reshape(n, -1), axis=1)
                    h = np.cumsum(np.bincount(at, weight, n * self.bins).reshape(n, -1), axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge) - all_g**2 / (all_h + self.ridge)
                    cut = gain.argmax(axis=1)
                    top = gain[np.arange(n), cut]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + n][better], split[first : first + n][better] = k, cut[better]
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, gradient, 2**self.depth) / (np.bincount(leaf, weight, 2**self.depth) + self.ridge)
            raw += value[leaf]
            features.append(feature)
            splits.append(split)
            leaves.append(value)
        self.feature, self.split, self.leaf = np.array(features), np.array(splits), np.array(leaves)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(x):
            binned = self._binned(x)
            for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
                out += leaf[self._leaves(binned, feature, split)]
        return out
