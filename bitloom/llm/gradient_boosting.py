"""Gradient-boosted trees for two classes on small tables, NumPy only, with a calibrated output."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: int = 0
    high: int = 0
    value: float = 0.0


@dataclass
class Boosted:
    """Trees on the log odds of the positive class; scale and shift calibrate them (Platt)."""

    depth: int = 3
    rounds: int = 40
    rate: float = 0.3
    ridge: float = 1.0
    base: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    trees: list[list[Node]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.base)
        cuts = [np.unique(c)[:-1] for c in x.T]
        cuts = [c if len(c) <= 32 else np.quantile(c, np.linspace(0, 1, 32)) for c in cuts]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), cuts)
            self.trees.append(tree)
            raw += self.rate * self._values(tree, x)
        return self

    def _grow(self, x, g, h, cuts) -> list[Node]:
        tree: list[Node] = []

        def add(rows: np.ndarray, depth: int) -> int:
            at, sg, sh = len(tree), g[rows].sum(), h[rows].sum()
            tree.append(Node(value=float(sg / (sh + self.ridge))))
            best = (1e-6, -1, 0.0)
            if depth:
                for f, cs in enumerate(cuts):
                    if not len(cs):
                        continue
                    below = x[rows, f][:, None] <= cs
                    lg, lh = g[rows] @ below, h[rows] @ below
                    gain = lg**2 / (lh + self.ridge) + (sg - lg) ** 2 / (sh - lh + self.ridge) - sg**2 / (sh + self.ridge)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float(cs[k]))
            if best[1] >= 0:
                go = x[rows, best[1]] <= best[2]
                tree[at].feature, tree[at].cut = best[1], best[2]
                tree[at].low = add(rows[go], depth - 1)
                tree[at].high = add(rows[~go], depth - 1)
            return at

        add(np.arange(len(g)), self.depth)
        return tree

    @staticmethod
    def _values(tree: list[Node], x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, cut = np.array([n.feature for n in tree]), np.array([n.cut for n in tree])
        low, high = np.array([n.low for n in tree]), np.array([n.high for n in tree])
        while len(rows := np.flatnonzero(feature[at] >= 0)):
            here = at[rows]
            at[rows] = np.where(x[rows, feature[here]] <= cut[here], low[here], high[here])
        return np.array([n.value for n in tree])[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._values(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Fits scale and shift on rows that were held out, by Newton's method on smoothed targets."""
        r, pos = self.raw(x), y.sum()
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * r + b)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((t - p) * r).sum(), (t - p).sum()])
            hess = np.array([[(w * r * r).sum() + 1e-6, (w * r).sum()], [(w * r).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a + step[0], b + step[1]
            if abs(step).max() < 1e-8:
                break
        self.scale, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))
