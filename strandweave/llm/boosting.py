"""Gradient-boosted regression trees for binary labels on numpy features, with Platt calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting; trees of fixed depth grown level by level on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 2.0):
        self.rate, self.depth = rate, depth
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    on = node == k
                    if on.sum() < 4:
                        continue
                    best = 1e-9
                    for j in range(x.shape[1]):
                        sg, sh = (np.cumsum(np.bincount(b[on, j], weights=w[on], minlength=bins + 1)) for w in (g, h))
                        left, right = (sg, sh), (sg[-1] - sg, sh[-1] - sh)
                        gain = left[0] ** 2 / (left[1] + least) + right[0] ** 2 / (right[1] + least) - sg[-1] ** 2 / (sh[-1] + least)
                        at = int(gain[:-1].argmax())
                        if gain[at] > best:
                            best, feature[k], cut[k] = gain[at], j, at
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=h, minlength=2**depth) + least)
            self.trees.append((feature, cut, value))
            f = f + rate * value[leaf]
        self.slope, self.shift = 1.0, 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += self.rate * value[node - (2**self.depth - 1)]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows that the trees have not seen."""
        m, a, c = self.margin(x), 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-4)
            g = np.array([((y - p) * m).mean() - 0.01 * (a - 1), (y - p).mean()])
            hess = np.array([[(w * m * m).mean() + 0.01, (w * m).mean()], [(w * m).mean(), w.mean() + 1e-6]])
            step = np.linalg.solve(hess, g)
            a, c = a + float(np.clip(step[0], -0.5, 0.5)), c + float(np.clip(step[1], -0.5, 0.5))
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = max(a, 0.05), c

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))
