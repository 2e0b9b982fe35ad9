"""Gradient-boosted trees for a yes/no label on a bounded sample, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees over binned features with logistic loss. Each tree is a full binary tree of ``depth`` levels, stored by heap index."""

    def __init__(self, depth: int = 4, trees: int = 80, rate: float = 0.12, bins: int = 48, l2: float = 1.0, least: float = 4.0):
        self.depth, self.trees, self.rate, self.bins, self.l2, self.least = depth, trees, rate, bins, l2, least
        self.features: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int64)
        share = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            score += self._grow(binned, edges, weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9))
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> np.ndarray:
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            best, at = np.zeros(count), np.full((count, 2), -1)
            for j in range(binned.shape[1]):
                if not len(edges[j]):
                    continue
                key = (node - first) * self.bins + binned[:, j]
                gs = np.cumsum(np.bincount(key, g, count * self.bins).reshape(count, self.bins), axis=1)
                hs = np.cumsum(np.bincount(key, h, count * self.bins).reshape(count, self.bins), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[(hs < self.least * 0.25) | (ht - hs < self.least * 0.25)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(count), top]
                better = value > best + 1e-9
                best = np.where(better, value, best)
                at[better] = np.stack([np.full(count, j), top], axis=1)[better]
            for k in range(count):
                if at[k, 0] >= 0:
                    feature[first + k], cut[first + k] = at[k, 0], edges[at[k, 0]][at[k, 1]]
            j, b = at[node - first].T
            right = (j >= 0) & (binned[np.arange(len(g)), np.maximum(j, 0)] > b)
            node = 2 * node + 1 + right
        leaf = node - inner
        value = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2)
        self.features.append(feature)
        self.cuts.append(cut)
        self.leaves.append(value)
        return value[leaf]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), (1 << self.depth) - 1
        for feature, cut, value in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


class Isotonic:
    """The non-decreasing step means of y by score (pool adjacent violators), joined by straight lines."""

    def fit(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, lowest and highest score
        for s, v, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
            blocks.append([v, w, s, s])
            while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
                v2, w2, _, top = blocks.pop()
                last = blocks[-1]
                last[0], last[1], last[3] = (last[0] * last[1] + v2 * w2) / (last[1] + w2), last[1] + w2, top
        self.at = np.array([x for b in blocks for x in (b[2], b[3])])
        self.value = np.array([b[0] for b in blocks for _ in range(2)])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.at, self.value), 0.0, 1.0)
