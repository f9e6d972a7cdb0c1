"""Gradient-boosted trees with logistic loss on histogram bins, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Boosted:
    """Complete trees of one depth: per tree and inner node a feature and a threshold (left: <=), per leaf a value."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            while node.max(initial=0) < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, ridge: float = 1.0) -> Boosted:
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], 1)
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    margin, inner = np.full(n, base), (1 << depth) - 1
    features, thresholds, leaves = (np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, k = (1 << level) - 1, 1 << level
            local = node - first
            best, gain = [(0, np.inf)] * k, np.full(k, 1e-6)
            for f in range(width):
                key = local * BINS + binned[:, f]
                gs, hs = (np.bincount(key, v, k * BINS).reshape(k, BINS).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                score = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                score = np.where((hs > 1) & (ht - hs > 1), score, 0)[:, : len(cuts[f])]
                if score.shape[1]:
                    at = score.argmax(1)
                    for i in np.flatnonzero(score[np.arange(k), at] > gain):
                        gain[i], best[i] = score[i, at[i]], (f, cuts[f][at[i]])
            for i, (f, c) in enumerate(best):
                features[t, first + i], thresholds[t, first + i] = f, c
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        leaves[t] = value
        margin += value[leaf]
    return Boosted(base, features, thresholds, leaves)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y (pool adjacent violators); between knots it is linear."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least and greatest margin
    for m, v in zip(margin[order], y[order]):
        blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            a, b = blocks[-2], blocks.pop()
            blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]]
    knots = [(m, (b[0] * b[1] + 0.5 * y.mean()) / (b[1] + 0.5)) for b in blocks for m in dict.fromkeys((b[2], b[3]))]
    at, value = map(np.array, zip(*knots))
    return at, np.maximum.accumulate(value)
