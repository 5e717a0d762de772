"""Gradient-boosted trees for two classes, and isotonic calibration, in numpy: small data in, a picklable model out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Complete binary trees of one depth, as arrays (tree, node); a row goes right where its feature is over the cut."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Newton boosting of the log loss over binned features; ties between splits go to the first feature and cut."""
    n, features = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    inner, leaves = 2**depth - 1, 2**depth
    out_f, out_c, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                of = np.flatnonzero(node == k)
                best, total_g, total_h = 1e-6, g[of].sum(), h[of].sum()
                for f in range(features):
                    if not len(cuts[f]) or not len(of):
                        continue
                    gb = np.bincount(binned[of, f], g[of], len(cuts[f]) + 1).cumsum()[:-1]
                    hb = np.bincount(binned[of, f], h[of], len(cuts[f]) + 1).cumsum()[:-1]
                    gain = gb**2 / (hb + ridge) + (total_g - gb) ** 2 / (total_h - hb + ridge) - total_g**2 / (total_h + ridge)
                    gain[(hb < least) | (total_h - hb < least)] = 0
                    b = int(gain.argmax())
                    if gain[b] > best:
                        best, feature[k], cut[k] = gain[b], f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        slot = node - inner
        leaf = -rate * np.bincount(slot, g, leaves) / (np.bincount(slot, h, leaves) + ridge)
        margin += leaf[slot]
        out_f.append(feature)
        out_c.append(cut)
        out_l.append(leaf)
    return Boosted(start, np.array(out_f), np.array(out_c), np.array(out_l), depth)


@dataclass
class Isotonic:
    """A rising piecewise-linear map from margins to probabilities."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each pool counts one half of each class more, so no probability is 0 or 1."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        pools.append([float(v), 1.0, m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, c = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + c]
    if not pools:
        return Isotonic(np.array([0.0]), np.array([0.5]))
    value = np.array([(s + 0.5) / (n + 1) for s, n, _ in pools])
    return Isotonic(np.array([t / n for _, n, t in pools]), np.maximum.accumulate(value))
