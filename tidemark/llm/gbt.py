"""Gradient-boosted trees for binary labels, in numpy: quantile bins, trees of fixed depth, Newton steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    start: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        depth = self.leaf.shape[1].bit_length() - 1
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, l2: float = 1.0, bins: int = 32, least: float = 5.0) -> Trees:
    """Rows x, labels y in 0 and 1. least: the smallest sum of second derivatives in a leaf."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: value <= edge b
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    logit, features, cuts, leaves = np.full(len(y), start), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-9)
            local = node - first
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                size = len(e) + 1
                key = local * size + binned[:, j]
                gs, hs = (np.bincount(key, v, width * size).reshape(width, size).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                at = gain[:, :-1].argmax(1)
                value = gain[np.arange(width), at]
                for n in np.flatnonzero(value > best):
                    best[n], feature[first + n], cut[first + n] = value[n], j, e[at[n]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        local = node - (2**depth - 1)
        leaf = rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + l2)
        logit += leaf[local]
        features.append(feature), cuts.append(cut), leaves.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), start)
