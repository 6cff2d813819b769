"""Gradient-boosted trees for a binary label, with Platt-calibrated probabilities; numpy only, deterministic."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of one depth as arrays over their inner nodes (breadth first) and leaves."""

    depth: int
    bias: float
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.offset)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss; the held-out rows calibrate the margins."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(depth, float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])) for j in range(x.shape[1])]
    margin = np.full(len(x), model.bias)
    for _ in range(trees):
        p = _sigmoid(margin)
        g, h = p - y, p * (1 - p)
        inner = 2**depth - 1
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), dtype=np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = 1e-9
            sum_g, sum_h = g[own].sum(), h[own].sum()
            for j, cut in enumerate(edges):
                if not len(own) or not len(cut):
                    continue
                bins = np.searchsorted(cut, x[own, j], side="left")
                left_g = np.bincount(bins, g[own], len(cut) + 1).cumsum()[:-1]
                left_h = np.bincount(bins, h[own], len(cut) + 1).cumsum()[:-1]
                gain = left_g**2 / (left_h + ridge) + (sum_g - left_g) ** 2 / (sum_h - left_h + ridge) - sum_g**2 / (sum_h + ridge)
                gain[(left_h < 1e-3) | (sum_h - left_h < 1e-3)] = 0
                if gain.max() > best:
                    best, feature[node], limit[node] = gain.max(), j, cut[gain.argmax()]
            at[own] = 2 * node + 1 + (x[own, feature[node]] > limit[node])
        leaf = np.zeros(2**depth)
        for k in range(2**depth):
            own = at == inner + k
            leaf[k] = -rate * g[own].sum() / (h[own].sum() + ridge)
        margin += leaf[at - inner]
        model.features.append(feature)
        model.limits.append(limit)
        model.leaves.append(leaf)
    z = model.margin(held_x)
    slope, offset = 1.0, 0.0
    target = np.where(held_y > 0, (held_y.sum() + 1) / (held_y.sum() + 2), 1 / ((1 - held_y).sum() + 2))
    for _ in range(50):  # Newton steps on the two calibration parameters
        p = _sigmoid(slope * z + offset)
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - target) * z).sum(), (p - target).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(slope), float(offset)
    return model
