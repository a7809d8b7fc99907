"""Gradient-boosted trees on histograms, flattened into node arrays for vectorised scoring.

The trainer sees a bounded matrix of statistics, never texts. Values are cut into at most ``bins`` quantile bins, trees
grow level by level, and a split on a constrained feature must keep the order of the two leaf values; the middle of the
two then bounds everything below, so the whole ensemble is monotonic in that feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in one set of arrays; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: all rows walk down all trees together, one level a step."""
        if not len(x):
            return np.empty(0)
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            f = self.feature[node]
            below = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(f < 0, node, below)
        if len(self.roots):
            total += self.value[node].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def constant_forest(probability: float) -> Forest:
    """No trees: every row gets the same score."""
    p = min(max(probability, 1e-6), 1 - 1e-6)
    none, zero = np.empty(0), np.empty(0, dtype=np.int64)
    return Forest(zero, none, zero, zero, none, zero, float(np.log(p / (1 - p))), 0)


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    penalty: float = 1.0,
    least_rows: int = 10,
    monotonic: dict[int, int] | None = None,
) -> Forest:
    """Logistic boosting. ``monotonic`` maps a feature to +1 (score may only rise with it) or -1 (only fall).

    With no rows or one class only, the result is constant: 0.5 without rows, else the share of label 1.
    """
    if not len(y):
        return constant_forest(0.5)
    if y.min() == y.max():
        return constant_forest(float(y.mean()))
    monotonic = monotonic or {}
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    cut = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        nodes.append([-1, 0, 0, 0, 0])
        level = {roots[-1]: (np.arange(n), -np.inf, np.inf)}
        for d in range(depth + 1):
            below = {}
            for node, (rows, low, high) in level.items():
                value = _leaf(grad[rows].sum(), hess[rows].sum(), penalty, low, high)
                split = None if d == depth or len(rows) < 2 * least_rows else _best(
                    cut[rows], grad[rows], hess[rows], edges, penalty, least_rows, monotonic, low, high
                )
                if split is None:
                    nodes[node][4] = rate * value
                    raw[rows] += rate * value
                    continue
                f, b, left_value, right_value = split
                goes_left = cut[rows, f] <= b
                nodes[node][:4] = [f, edges[f][b], len(nodes), len(nodes) + 1]
                middle = (left_value + right_value) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(
                    monotonic.get(f, 0), ((low, high), (low, high))
                )
                for mask, (lo, hi) in zip((goes_left, ~goes_left), bounds, strict=True):
                    below[len(nodes)] = (rows[mask], lo, hi)
                    nodes.append([-1, 0, 0, 0, 0])
            level = below
    flat = np.array(nodes)
    whole = [flat[:, k].astype(np.int64) for k in (0, 2, 3)]
    return Forest(whole[0], flat[:, 1], whole[1], whole[2], flat[:, 4], np.array(roots), base, depth)


def _leaf(grad: float, hess: float, penalty: float, low: float, high: float) -> float:
    return float(np.clip(-grad / (hess + penalty), low, high))


def _best(cut, grad, hess, edges, penalty, least_rows, monotonic, low, high):
    """The split of highest gain: feature, bin, and the values left and right of it."""
    best, found = 1e-9, None
    total_g, total_h, n = grad.sum(), hess.sum(), len(grad)
    parent = total_g**2 / (total_h + penalty)
    for f, at in enumerate(edges):
        if not len(at):
            continue
        size = len(at) + 1
        g = np.cumsum(np.bincount(cut[:, f], weights=grad, minlength=size))[:-1]
        h = np.cumsum(np.bincount(cut[:, f], weights=hess, minlength=size))[:-1]
        c = np.cumsum(np.bincount(cut[:, f], minlength=size))[:-1]
        left = np.clip(-g / (h + penalty), low, high)
        right = np.clip(-(total_g - g) / (total_h - h + penalty), low, high)
        gain = g**2 / (h + penalty) + (total_g - g) ** 2 / (total_h - h + penalty) - parent
        allowed = (c >= least_rows) & (n - c >= least_rows)
        if f in monotonic:
            allowed &= monotonic[f] * (right - left) >= 0
        gain = np.where(allowed, gain, -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > best:
            best, found = gain[b], (f, b, float(left[b]), float(right[b]))
    return found
