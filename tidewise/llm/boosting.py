"""Gradient-boosted trees on feature histograms, for a binary label.

Features are cut into at most ``BINS`` quantile bins; each level of a tree is
grown from histograms of gradients over (node, feature, bin). The trees are
complete and kept in flat arrays (feature, threshold, leaf value by node number),
so that scoring walks all rows and trees by array indexing, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold`` are (tree, inner node), ``value`` (tree,
    leaf); node i has the children 2i+1 and 2i+2; a row goes right when its
    feature exceeds the threshold. ``base`` is the log-odds without trees."""
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        n_trees, inner = self.feature.shape
        node = np.zeros((n_trees, len(x)), np.int64)
        tree, row = np.arange(n_trees)[:, None], np.arange(len(x))
        for _ in range(int(np.log2(inner + 1))):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return self.base + self.value[tree, node - inner].sum(axis=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(np.asarray(x, np.float64))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15,
        ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Trees for labels 0/1. Without rows of both labels, the score is the share
    of label 1 (1/2 if there are no rows)."""
    inner = 2 ** depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)),
                     np.zeros((0, inner + 1)))
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    n_rows, n_features = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower"))
            for j in range(n_features)]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = codes + np.arange(n_features) * BINS
    margin = np.full(n_rows, base)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(n_rows, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            index = ((node - first)[:, None] * (n_features * BINS) + flat).ravel()
            shape = (width, n_features, BINS)
            size = width * n_features * BINS
            g = np.bincount(index, np.repeat(gradient, n_features), size).reshape(shape).cumsum(2)
            h = np.bincount(index, np.repeat(weight, n_features), size).reshape(shape).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = (g ** 2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge)
                    - g_all ** 2 / (h_all + ridge))
            gain[(h < least * 0.1) | (h_all - h < least * 0.1)] = 0
            gain[:, :, -1] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n_rows), feature[node]] > threshold[node])
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, weight, inner + 1)
        value = -rate * g / (h + ridge)
        margin += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Trees(base, np.array(out_f), np.array(out_t), np.array(out_v))
