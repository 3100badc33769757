"""Gradient-boosted trees on small dense features, with isotonic calibration; deterministic."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic boosting of depth-wise trees over quantile bins."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    least: int = 8
    ridge: float = 1.0
    bias: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def _raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        width, (n, d) = 33, x.shape
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.bias, self.trees = float(np.log(mean / (1 - mean))), []
        raw, inner = np.full(n, self.bias), 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
            feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for here in range(first, 2 * first + 1):
                    rows = np.flatnonzero(node == here)
                    if len(rows) < 2 * self.least:
                        continue
                    key = (bins[rows] + np.arange(d) * width).ravel()
                    g, h, c = (np.bincount(key, np.repeat(v, d), d * width).reshape(d, width).cumsum(axis=1)[:, :-1] for v in (grad[rows], hess[rows], np.ones(len(rows))))
                    gt, ht = grad[rows].sum(), hess[rows].sum()
                    gain = g * g / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge)
                    gain[(c < self.least) | (len(rows) - c < self.least)] = -1
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > gt * gt / (ht + self.ridge) + 1e-9 and b < len(edges[f]):
                        feature[here], cut[here] = f, edges[f][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = np.bincount(node - inner, grad, inner + 1) / (np.bincount(node - inner, hess, inner + 1) + self.ridge) * self.rate
            self.trees.append((feature, cut, leaf))
            raw += leaf[node - inner]
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Isotonic regression of held-out labels on raw scores, by pooling adjacent violators."""
        raw = self._raw(x)
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []
        for r, t in zip(raw[order], y[order], strict=True):
            blocks.append([r, float(t), 1.0])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                r2, t2, n2 = blocks.pop()
                blocks[-1] = [r2, blocks[-1][1] + t2, blocks[-1][2] + n2]
        self.knots = np.array([b[0] for b in blocks])
        self.levels = np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self._raw(x), self.knots, self.levels) if len(x) else np.zeros(0)
