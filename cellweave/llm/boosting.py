"""Histogram gradient-boosted trees in numpy, kept as flat arrays."""

from __future__ import annotations

import numpy as np


class Trees:
    """Binary log-loss boosting. Features are cut at quantiles into BINS bins; a level
    of a tree is grown from one histogram of gradients for all its nodes. Every tree
    is full to `depth`, so the nodes of all trees lie in rectangular arrays, children
    of node i at 2i + 1 and 2i + 2, and a row is scored by `depth` array lookups."""

    def __init__(self, n_trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.ridge = n_trees, depth, rate, bins, least, ridge
        self.base = 0.0
        inner = (1 << depth) - 1
        self.feature = np.zeros((n_trees, inner), np.int32)
        self.cut = np.full((n_trees, inner), np.inf, np.float64)
        self.leaf = np.zeros((n_trees, inner + 1), np.float64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        n, f = x.shape
        rate = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(rate / (1 - rate)))
        if n == 0:
            return self
        # A value is in bin k if k cuts lie under it; a split at k sends bins <= k left.
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1], method="lower")) for j in range(f)]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        flat = binned + np.arange(f) * self.bins
        score = np.full(n, self.base)
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, many = (1 << level) - 1, 1 << level
                at = ((node - first)[:, None] * (f * self.bins) + flat).ravel()
                size = many * f * self.bins
                sums = [np.bincount(at, np.repeat(v, f), size).reshape(many, f, self.bins).cumsum(axis=2) for v in (g, h)]
                left_g, left_h = sums
                all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
                gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g**2 / (all_h + self.ridge)
                usable = (left_h >= self.least) & (all_h - left_h >= self.least)
                for j, c in enumerate(cuts):
                    usable[:, j, len(c) :] = False
                gain = np.where(usable, gain, -np.inf).reshape(many, -1)
                best = gain.argmax(axis=1)
                split = gain[np.arange(many), best] > 1e-9
                for k in np.flatnonzero(split).tolist():
                    j, b = divmod(int(best[k]), self.bins)
                    self.feature[t, first + k], self.cut[t, first + k] = j, cuts[j][b]
                node = 2 * node + 1 + (x[np.arange(n), self.feature[t, node]] > self.cut[t, node])
            own = node - ((1 << self.depth) - 1)
            self.leaf[t] = -self.rate * np.bincount(own, g, self.leaf.shape[1]) / (np.bincount(own, h, self.leaf.shape[1]) + self.ridge)
            score += self.leaf[t, own]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        x = np.asarray(x, np.float64)
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(self.n_trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            score += self.leaf[t, node - ((1 << self.depth) - 1)]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))
