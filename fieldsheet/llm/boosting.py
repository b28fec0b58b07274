"""Gradient-boosted trees on binned features, in numpy: logistic loss, soft targets, sample weights."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Complete trees of equal depth, as arrays: a split is a feature and a bin in every inner node."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.ridge = trees, depth, rate, ridge

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b, n = self.bins(x), len(y)
        mean = np.clip(np.average(y, weights=weight), 0.01, 0.99)
        self.base = float(np.log(mean / (1 - mean)))
        self.features = np.zeros((self.trees, 2**self.depth - 1), dtype=np.int64)
        self.cuts = np.full((self.trees, 2**self.depth - 1), 255, dtype=np.uint8)
        self.leaves = np.zeros((self.trees, 2**self.depth))
        f = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                k = 2**level
                best = np.full(k, 1e-6)
                for j in range(x.shape[1]):
                    at = node * BINS + b[:, j]
                    cg = np.bincount(at, g, k * BINS).reshape(k, BINS).cumsum(axis=1)
                    ch = np.bincount(at, h, k * BINS).reshape(k, BINS).cumsum(axis=1)
                    tg, th = cg[:, -1:], ch[:, -1:]
                    gain = cg**2 / (ch + self.ridge) + (tg - cg) ** 2 / (th - ch + self.ridge) - tg**2 / (th + self.ridge)
                    cut = gain.argmax(axis=1)
                    top = gain[np.arange(k), cut]
                    for i in np.flatnonzero(top > best):
                        best[i] = top[i]
                        self.features[t, k - 1 + i], self.cuts[t, k - 1 + i] = j, cut[i]
                node = self._down(b, node, t, k)
            size = 2**self.depth
            self.leaves[t] = self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.ridge)
            f += self.leaves[t][node]
        return self

    def _down(self, b: np.ndarray, node: np.ndarray, t: int, k: int) -> np.ndarray:
        i = k - 1 + node
        return 2 * node + (b[np.arange(len(b)), self.features[t, i]] > self.cuts[t, i])

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, f = self.bins(x), np.full(len(x), self.base)
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                node = self._down(b, node, t, 2**level)
            f += self.leaves[t][node]
        return f
