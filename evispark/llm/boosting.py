"""Gradient-boosted trees of fixed depth for a few numeric features, fitted on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 16


@dataclass
class Trees:
    """cuts: the bins' upper ends per feature; feature and cut: per tree and inner node; value: per tree and leaf."""

    cuts: list[np.ndarray]
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the positive class."""
        bins, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:  # all rows stand at the same depth
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over histograms of binned features."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    inner = 2**depth - 1
    model = Trees(cuts, float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.zeros((trees, inner), np.int64), np.zeros((trees, inner + 1)))
    bins = model.binned(x)
    flat = bins + np.arange(x.shape[1]) * BINS
    margin = np.full(len(x), model.base)
    size = x.shape[1] * BINS

    def tally(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        counted = np.bincount(flat[rows].ravel(), np.repeat(weight[rows], x.shape[1]), size)
        return np.cumsum(counted.reshape(-1, BINS), axis=1)

    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, p * (1 - p)
        held = {0: np.arange(len(x))}
        for node in range(inner):
            rows = held.pop(node)
            g, h = tally(rows, gradient), tally(rows, curve)
            total_g, total_h = gradient[rows].sum(), curve[rows].sum()
            gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge)
            k, b = np.unravel_index(int(gain.argmax()), gain.shape)
            model.feature[t, node], model.cut[t, node] = k, b
            right = bins[rows, k] > b
            held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
        for leaf, rows in held.items():
            value = rate * gradient[rows].sum() / (curve[rows].sum() + ridge)
            model.value[t, leaf - inner] = value
            margin[rows] += value
    return model
