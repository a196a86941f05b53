"""Gradient-boosted decision trees for a few classes, on binned statistics."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Softmax boosting: each round adds a small tree for every class.

    Splits are searched on up to ``bins`` quantiles of each column; leaves have
    Newton steps. Probabilities are softened by a temperature that ``calibrate``
    finds.
    """

    def __init__(self, classes: int, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, penalty: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.penalty = classes, rounds, depth, rate, bins, penalty
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.prior = np.zeros(classes)
        self.temperature = 1.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns and bins of the inner nodes, and values of the leaves, of a complete tree."""
        inner = (1 << self.depth) - 1
        column, split = np.zeros(inner, int), np.full(inner, self.bins + 1)
        node = np.zeros(len(b), int)
        width = self.bins + 1
        for d in range(self.depth):
            first = (1 << d) - 1
            for k in range(first, first + (1 << d)):
                at = np.flatnonzero(node == k)
                best = 1e-6
                if len(at) > 2:
                    gs, hs = g[at], h[at]
                    whole = gs.sum() ** 2 / (hs.sum() + self.penalty)
                    for j in range(b.shape[1]):
                        bj = b[at, j]
                        gl = np.cumsum(np.bincount(bj, gs, width))[:-1]
                        hl = np.cumsum(np.bincount(bj, hs, width))[:-1]
                        gain = gl**2 / (hl + self.penalty) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + self.penalty) - whole
                        i = int(gain.argmax())
                        if gain[i] > best:
                            best, column[k], split[k] = gain[i], j, i
                node[at] = 2 * k + 1 + (b[at, column[k]] > split[k])
        leaf = node - inner
        n = 1 << self.depth
        return column, split, np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.penalty)

    def _leaf(self, b: np.ndarray, column: np.ndarray, split: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), int)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, column[node]] > split[node])
        return node - len(column)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles)) if len(x) else np.empty(0) for j in range(x.shape[1])]
        self.prior = np.log((np.bincount(y, minlength=self.classes) + 1) / (len(y) + self.classes))
        if not len(x):
            return self
        b = self._binned(x)
        f = np.tile(self.prior, (len(x), 1))
        hot = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = self._softmax(f)
            trees = [self._tree(b, hot[:, c] - p[:, c], p[:, c] * (1 - p[:, c])) for c in range(self.classes)]
            for c, t in enumerate(trees):
                f[:, c] += self.rate * t[2][self._leaf(b, *t[:2])]
            self.trees.append(trees)
        return self

    @staticmethod
    def _softmax(f: np.ndarray) -> np.ndarray:
        e = np.exp(f - f.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = np.tile(self.prior, (len(x), 1))
        if len(x) and self.trees:
            b = self._binned(x)
            for trees in self.trees:
                for c, t in enumerate(trees):
                    f[:, c] += self.rate * t[2][self._leaf(b, *t[:2])]
        return f

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(self.scores(x) / self.temperature)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Set the temperature with the least log loss on a holdout."""
        f = self.scores(x)
        tried = np.geomspace(0.25, 8, 41)
        loss = [-np.log(self._softmax(f / t)[np.arange(len(y)), y] + 1e-12).mean() for t in tried]
        self.temperature = float(tried[int(np.argmin(loss))])
        return self
