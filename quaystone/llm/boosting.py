"""Boosted trees for two classes in numpy, with calibrated scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH, ROUNDS, RATE, LEAST_LEAF = 3, 40, 0.3, 4.0


@dataclass
class Trees:
    """Complete binary trees: feature and threshold of the inner nodes, value of the leaves; then the calibration."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    knots: np.ndarray
    chances: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - len(f)]
        return total

    def chance(self, x: np.ndarray) -> np.ndarray:
        """The calibrated chance of the positive class."""
        if not len(x):
            return np.zeros(0)
        return np.interp(self.raw(x), self.knots, self.chances)

    def selects(self, x: np.ndarray) -> np.ndarray:
        return self.chance(x) >= self.cut


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    inner = 2**DEPTH - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(x), np.int64)
    for node in range(inner):
        mine = np.flatnonzero(at == node)
        best = (1e-6, 0, np.inf)
        if len(mine) > 1:
            gs, hs = g[mine], h[mine]
            whole = gs.sum() ** 2 / (hs.sum() + 1)
            for f in range(x.shape[1]):
                values, inverse = np.unique(x[mine, f], return_inverse=True)
                if len(values) < 2:
                    continue
                gl = np.cumsum(np.bincount(inverse, gs))[:-1]
                hl = np.cumsum(np.bincount(inverse, hs))[:-1]
                n = np.cumsum(np.bincount(inverse))[:-1]
                gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1) - whole
                gain[(n < LEAST_LEAF) | (len(mine) - n < LEAST_LEAF)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, (values[k] + values[k + 1]) / 2)
        feature[node], threshold[node] = best[1], best[2]
        at[mine] = 2 * node + 1 + (x[mine, best[1]] > best[2])
    leaves = at - inner
    g_sum, h_sum = np.bincount(leaves, g, 2**DEPTH), np.bincount(leaves, h, 2**DEPTH)
    return feature, threshold, g_sum / (h_sum + 1), at


def _isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: score knots and rising chances, shrunk a little from 0 and 1."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    knots, chances = [], []
    for total, n, lo, hi in blocks:
        p = (total + 0.05) / (n + 0.1)
        knots += [lo, hi + 1e-9]
        chances += [p, p]
    return np.array(knots), np.array(chances)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Trees:
    """Trees on four fifths of the rows, calibration and the threshold of the best F1 on the rest."""
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(x))
    held, used = part[: len(x) // 5], part[len(x) // 5 :]
    if not len(held) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        none = np.zeros((0, 2**DEPTH - 1))
        return Trees(0.0, none.astype(np.int64), none, np.zeros((0, 2**DEPTH)), np.array([0.0, 1.0]), np.array([p, p]), 0.5)
    p = np.clip(y[used].mean(), 0.01, 0.99)
    bias = float(np.log(p / (1 - p)))
    total = np.full(len(used), bias)
    features, thresholds, leaves = [], [], []
    for _ in range(ROUNDS):
        chance = 1 / (1 + np.exp(-total))
        f, t, v, at = _tree(x[used], y[used] - chance, chance * (1 - chance))
        features.append(f)
        thresholds.append(t)
        leaves.append(RATE * v)
        total += RATE * v[at - len(f)]
    trees = Trees(bias, np.array(features), np.array(thresholds), np.array(leaves), np.array([0.0, 1.0]), np.array([0.0, 1.0]), 0.5)
    trees.knots, trees.chances = _isotonic(trees.raw(x[held]), y[held].astype(float))
    chance = trees.chance(x[held])
    best = (-1.0, 0.5)
    for c in np.unique(np.r_[chance, 0.5]):
        hit = chance >= c
        good = (hit & (y[held] == 1)).sum()
        f1 = 2 * good / max(1, hit.sum() + y[held].sum())
        if f1 > best[0] + 1e-9 or abs(f1 - best[0]) < 1e-9 and abs(c - 0.5) < abs(best[1] - 0.5):
            best = (f1, float(c))
    trees.cut = best[1]
    return trees
