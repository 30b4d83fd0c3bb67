"""Gradient-boosted trees on binned features and isotonic calibration, fitted on a bounded sample with NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Trees:
    """Boosted complete trees of one depth: per tree, the feature and bound of each inner node and the leaf values."""

    depth: int = 3
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    bounds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, b, v in zip(self.features, self.bounds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += v[at - (1 << self.depth) + 1]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, ridge: float = 5.0) -> Trees:
    """Logistic loss, Newton leaves, histograms over quantile bins. One class or no rows: the smoothed base rate."""
    w = np.ones(len(y)) if weight is None else weight
    rate_1 = (np.dot(w, y) + 0.5) / (w.sum() + 1)
    model = Trees(depth, float(np.log(rate_1 / (1 - rate_1))))
    if len(y) == 0 or y.min() == y.max():
        return model
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    raw = np.full(n, model.base)
    column = np.arange(m) * bins
    for _ in range(rounds):
        p = _sigmoid(raw)
        g, h = w * (y - p), w * p * (1 - p)
        at = np.zeros(n, np.int64)
        f, b = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            first, k = (1 << level) - 1, 1 << level
            key = ((at - first)[:, None] * (m * bins) + column + code).ravel()
            shape = (k, m, bins)
            gs = np.bincount(key, np.repeat(g, m), k * m * bins).reshape(shape).cumsum(2)
            hs = np.bincount(key, np.repeat(h, m), k * m * bins).reshape(shape).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            best = gain.reshape(k, -1).argmax(1)
            for node in range(k):
                j, c = divmod(int(best[node]), bins)
                if gain[node, j, c] > 1e-9 and c < len(cuts[j]):
                    f[first + node], b[first + node] = j, cuts[j][c]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > b[at])
        leaf = at - (1 << depth) + 1
        v = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        model.features.append(f), model.bounds.append(b), model.leaves.append(v)
        raw += v[leaf]
    return model


@dataclass
class Isotonic:
    """A non-decreasing map from raw scores to rates, linear between its points."""

    at: np.ndarray
    to: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.to)


def fit_isotonic(score: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
    """Pool adjacent violators, each pool's rate shrunk by `prior` rows at the overall rate; no rows: the identity."""
    if len(y) == 0 or y.min() == y.max():
        return Isotonic(np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, first score, last score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if pools and pools[-1][3] == s:
            pools[-1][0] += v
            pools[-1][1] += 1
        else:
            pools.append([v, 1, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v1, n1, _, last = pools.pop()
            pools[-1][0] += v1
            pools[-1][1] += n1
            pools[-1][3] = last
    rate = float(np.mean(y))
    at, to = [], []
    for v, n, a, b in pools:
        r = (v + prior * rate) / (n + prior)
        at += [a, b] if b > a else [a]
        to += [r, r] if b > a else [r]
    return Isotonic(np.array(at), np.maximum.accumulate(np.array(to)))
