"""Gradient-boosted trees for two classes, in numpy: histogram splits, logistic loss, isotonic calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete binary trees of one depth, stored as arrays; prediction walks all rows a level at a time."""

    def __init__(self, n_trees: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.l2 = n_trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, k = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        z = np.full(n, self.base)
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.n_trees, inner), np.int32)
        self.cut = np.full((self.n_trees, inner), np.inf)
        self.leaf = np.zeros((self.n_trees, inner + 1))
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for q in range(first, 2 * first + 1):
                    rows = np.flatnonzero(node == q)
                    gain, j, c = self._best(b[rows], g[rows], h[rows])
                    if gain > 1e-6:
                        self.feature[t, q], self.cut[t, q] = j, self.cuts[j][c]
                        node[rows] = 2 * q + 1 + (b[rows, j] > c)
                    else:
                        node[rows] = 2 * q + 1
            node -= inner
            top = np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + self.l2)
            self.leaf[t] = self.rate * top
            z += self.leaf[t][node]
        return self

    def _best(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        best = (0.0, 0, 0)
        if len(b) < 8:
            return best
        gs, hs = g.sum(), h.sum()
        for j, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            gl = np.cumsum(np.bincount(b[:, j], g, len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(b[:, j], h, len(cuts) + 1))[:-1]
            gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (float(gain[c]), j, c)
        return best

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(self.n_trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.leaf[t, node - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing knots of the score and the probability at each."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(s), float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, v2, n2 = blocks.pop()
            blocks[-1][1] += v2
            blocks[-1][2] += n2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on at least ``precision`` of the rows are positive; 1.01 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)
    good = np.flatnonzero((right >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else 1.01
