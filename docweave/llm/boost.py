"""Gradient-boosted trees for two classes, small enough to fit on a driver's sample and to travel in a closure."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, trees of fixed depth over quantile bins; the same rows in any order give the same model."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 4):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        order = np.lexsort((y, *x.T))
        x, y = x[order].astype(np.float64), y[order].astype(np.float64)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            tree: list = []
            leaf = np.zeros(len(y), dtype=np.int64)
            self._grow(tree, binned, edges, g, h, np.arange(len(y)), leaf, 0)
            self.trees.append(tree)
            f += self.rate * np.array([t[3] for t in tree])[leaf]
        return self

    def _grow(self, tree: list, binned, edges, g, h, rows, leaf, depth: int) -> int:
        at = len(tree)
        # a node is [feature, edge, right child, value]; a leaf has feature -1, the left child follows its parent
        tree.append([-1, 0.0, 0, float(g[rows].sum() / (h[rows].sum() + 1.0))])
        leaf[rows] = at
        if depth == self.depth or len(rows) < 2 * self.least:
            return at
        best, gain = None, 1e-6
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j, e in enumerate(edges):
            if not len(e):
                continue
            k = len(e) + 1
            b = binned[rows, j]
            sg, sh, n = (np.cumsum(np.bincount(b, weights=w, minlength=k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            ok = (n >= self.least) & (len(rows) - n >= self.least)
            score = np.where(ok, sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1), -1)
            c = int(score.argmax())
            if score[c] > gain:
                best, gain = (j, c), score[c]
        if best is None:
            return at
        j, c = best
        left = binned[rows, j] <= c
        tree[at][0], tree[at][1] = j, float(edges[j][c])
        self._grow(tree, binned, edges, g, h, rows[left], leaf, depth + 1)
        tree[at][2] = self._grow(tree, binned, edges, g, h, rows[~left], leaf, depth + 1)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row."""
        x = np.atleast_2d(np.asarray(x, dtype=np.float64))
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, edge, right, value in self._compiled():
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                own = feature[at]
                go_left = x[rows, np.maximum(own, 0)] <= edge[at]
                at = np.where(own >= 0, np.where(go_left, at + 1, right[at]), at)
            f += self.rate * value[at]
        return 1 / (1 + np.exp(-f))

    def _compiled(self) -> list[tuple]:
        if not hasattr(self, "arrays"):
            self.arrays = [(np.array([t[0] for t in tree]), np.array([t[1] for t in tree]), np.array([t[2] for t in tree]), np.array([t[3] for t in tree])) for tree in self.trees]
        return self.arrays
