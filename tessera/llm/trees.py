"""Gradient-boosted trees on binned features and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with depth-limited trees over quantile bins; fitted on the driver."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 3):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        p = np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4)
        self.base, self.nodes = float(np.log(p / (1 - p))), []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
        for j in range(width):  # sparse columns: quantiles of the non-zero part too, or every cut would be 0
            if n and (some := x[x[:, j] > 0, j]).size:
                cuts[j] = np.unique(np.concatenate([cuts[j], [0.0], np.quantile(some, np.linspace(0, 1, self.bins // 2 + 1)[1:-1])]))
        codes = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], 1) if n else np.zeros((0, width), np.int64)
        score = np.full(n, self.base)
        for _ in range(self.trees if n else 0):
            prob = 1 / (1 + np.exp(-score))
            tree = self._grow(codes, cuts, prob - y, prob * (1 - prob))
            self.nodes.append(tree)
            score += self._leaf(tree, x)
        return self

    def _grow(self, codes, cuts, grad, hess):
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        rows = {0: np.arange(len(grad))}
        for node in range(size):
            at = rows.pop(node, None)
            if at is None:
                continue
            g, h = grad[at].sum(), hess[at].sum()
            value[node] = -self.rate * g / (h + self.ridge)
            if node >= 2**self.depth - 1 or len(at) < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            for j, edges in enumerate(cuts):
                if not len(edges):
                    continue
                c = codes[at, j]
                gs = np.cumsum(np.bincount(c, grad[at], len(edges) + 1))[:-1]
                hs = np.cumsum(np.bincount(c, hess[at], len(edges) + 1))[:-1]
                ns = np.cumsum(np.bincount(c, minlength=len(edges) + 1))[:-1]
                gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
                gain[(ns < self.least) | (len(at) - ns < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                _, j, k = best
                feature[node], cut[node] = j, cuts[j][k]
                left = codes[at, j] <= k
                rows[2 * node + 1], rows[2 * node + 2] = at[left], at[~left]
        return feature, cut, value

    def _leaf(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            down = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
            node = np.where(down, 2 * node + 1 + right, node)
        return value[node]

    def decision(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.nodes:
            score += self._leaf(tree, x)
        return score


class Isotonic:
    """Pool-adjacent-violators fit of P(y | score), linear between block centres."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of y, weight, sum of scores
        for s, t in zip(score[order], y[order]):
            blocks.append([float(t), 1.0, float(s)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.x = np.array([b[2] / b[1] for b in blocks] or [0.0])
        self.y = np.array([b[0] / b[1] for b in blocks] or [0.0])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
