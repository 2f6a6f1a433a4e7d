"""Histogram gradient-boosted trees for a yes/no target, in numpy.

Features are cut into at most 255 bins at quantiles; each level of a tree is grown from per-node histograms of
gradients. A fitted model is flattened into three arrays of complete binary trees (a node that isn't split sends every
row left), so that scoring is a few vectorised gathers for each level of each tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 255


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # rows with a value above it go right
    value: np.ndarray  # (trees, 2**depth)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.value.shape[1].bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def constant(p: float) -> Trees:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Trees(np.zeros((0, 1), np.int32), np.zeros((0, 1)), np.zeros((0, 2)), float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 3.0) -> Trees:
    """`least`: sum of second derivatives that each side of a split needs."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    out_f, out_t, out_v = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)  # within its level
        for level in range(depth):
            width_now = 2**level
            best_gain, best_f, best_bin = np.full(width_now, 1e-6), np.full(width_now, -1), np.zeros(width_now, np.int64)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                at, size = node * (BINS + 1) + binned[j], width_now * (BINS + 1)
                gl = np.bincount(at, g, size).reshape(width_now, -1).cumsum(1)
                hl = np.bincount(at, h, size).reshape(width_now, -1).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width_now), top]
                better = value > best_gain
                best_gain[better], best_f[better], best_bin[better] = value[better], j, top[better]
            right = np.zeros(n, dtype=np.int64)
            for m in np.flatnonzero(best_f >= 0):
                out_f[k, width_now - 1 + m], out_t[k, width_now - 1 + m] = best_f[m], cuts[best_f[m]][best_bin[m]]
                own = node == m
                right[own] = binned[best_f[m]][own] > best_bin[m]
            node = 2 * node + right
        out_v[k] = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + l2)
        margin += out_v[k][node]
    return Trees(out_f, out_t, out_v, base)
