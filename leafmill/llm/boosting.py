"""Gradient-boosted trees for a yes/no question, on histograms of the features. Small: they travel to the tasks as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete trees of one depth: at node ``k``, go to 2k+2 if feature > cut, else to 2k+1; then a leaf's value."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of yes for each row."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2, least: float = 5.0) -> Trees:
    """Fit to rows ``x`` with answers ``y`` (0 or 1) by second-order boosting of the log loss."""
    n, width = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) if n else np.zeros(1) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1) if n else np.zeros((0, width), np.int64)
    out = Trees(base, np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves)))
    score = np.full(n, base)
    for t in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = 1e-6
            if len(mine) >= 2 * least:
                total_g, total_h = g[mine].sum(), h[mine].sum()
                for j in range(width):
                    bins = binned[mine, j]
                    left_g = np.cumsum(np.bincount(bins, g[mine], minlength=len(edges[j]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(bins, h[mine], minlength=len(edges[j]) + 1))[:-1]
                    count = np.cumsum(np.bincount(bins, minlength=len(edges[j]) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    gain[(count < least) | (len(mine) - count < least)] = 0
                    if len(gain) and gain.max() > best:
                        best, out.feature[t, node], out.cut[t, node] = gain.max(), j, edges[j][gain.argmax()]
            at[mine] = 2 * node + 1 + (x[mine, out.feature[t, node]] > out.cut[t, node])
        leaf = at - inner
        sums_g, sums_h = np.bincount(leaf, g, minlength=leaves), np.bincount(leaf, h, minlength=leaves)
        out.value[t] = rate * sums_g / (sums_h + 1)
        score += out.value[t][leaf]
    return out
