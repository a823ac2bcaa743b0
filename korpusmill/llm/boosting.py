"""Gradient-boosted trees for two classes, in numpy."""

from __future__ import annotations

import numpy as np

from korpusmill.llm.labelled import sigmoid


class Boosted:
    """Complete trees of one depth, each level a vector of (feature, threshold); values at the leaves."""

    def __init__(self, bias: float, features: np.ndarray, cuts: np.ndarray, leaves: np.ndarray):
        self.bias, self.features, self.cuts, self.leaves = bias, features, cuts, leaves

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows, inner = np.arange(len(x)), self.features.shape[1]
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, least: int = 8, ridge: float = 1.0) -> Boosted:
    """Second-order boosting of the log loss over binned features."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="lower")) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]).astype(np.int64)
    key = binned + np.arange(width) * bins
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    score, inner = np.full(n, bias), 2**depth - 1
    features, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        q = sigmoid(score)
        g, h = y - q, np.maximum(q * (1 - q), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for node in range(first, 2 * first + 1):
                rows = np.flatnonzero(at == node)
                if len(rows) >= 2 * least:
                    k = key[rows].ravel()
                    gs, hs, ns = (np.bincount(k, np.repeat(v, width), width * bins).reshape(width, bins).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows))))
                    G, H, N = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + ridge) + (G - gs) ** 2 / (H - hs + ridge) - G**2 / (H + ridge)
                    gain[(ns < least) | (N - ns < least)] = 0
                    j, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(edges[j]):
                        features[t, node], cuts[t, node] = j, edges[j][b]
                at[rows] = 2 * node + 1 + (x[rows, features[t, node]] > cuts[t, node])
        leaf = at - inner
        leaves[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += leaves[t][leaf]
    return Boosted(bias, features, cuts, leaves)
