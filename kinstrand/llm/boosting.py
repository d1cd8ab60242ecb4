"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete binary trees of one depth. Node k has children 2k+1 (bin at most ``cut``) and 2k+2."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self.bins(x)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += value[node - (1 << self.depth) + 1]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, n_bins: int = 32, ridge: float = 1.0) -> BoostedTrees:
    """Logistic loss, second-order gains, ``n_bins`` quantile bins a feature."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) for k in range(x.shape[1])]
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = BoostedTrees(edges, float(np.log(share / (1 - share))), np.zeros((0, 0), int), np.zeros((0, 0), int), np.zeros((0, 0)), depth)
    binned = model.bins(x).astype(np.int64)
    score = np.full(len(y), model.base)
    shift = np.arange(x.shape[1]) * n_bins
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, n_bins, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                rows = np.flatnonzero(node == k)
                if len(rows) < 8:
                    continue
                flat = (binned[rows] + shift).ravel()
                sums = lambda w: np.bincount(flat, np.repeat(w[rows], x.shape[1]), minlength=x.shape[1] * n_bins).reshape(-1, n_bins).cumsum(1)  # noqa: B023, E731
                gl, hl = sums(g), sums(h)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                best = int(np.argmax(gain[:, :-1]))
                if gain[:, :-1].ravel()[best] > 1e-6:
                    feature[k], cut[k] = divmod(best, n_bins - 1)
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (1 << depth) + 1
        value = rate * np.bincount(leaf, g, minlength=1 << depth) / (np.bincount(leaf, h, minlength=1 << depth) + ridge)
        score += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    model.feature, model.cut, model.value = np.array(features), np.array(cuts), np.array(values)
    return model
