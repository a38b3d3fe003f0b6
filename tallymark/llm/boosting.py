"""Small gradient-boosted trees for two classes, fitted on the driver from a bounded sample and applied as SQL expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple
"""(feature, threshold, tree if value <= threshold, tree otherwise), or (value,) for a leaf."""


def fit_tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int = 10, ridge: float = 1.0) -> Tree:
    """A tree of Newton steps by exact greedy splits; ties go to the lower feature and threshold."""
    leaf = (float(grad.sum() / (hess.sum() + ridge)),)
    best, parent = (1e-6, None, None), grad.sum() ** 2 / (hess.sum() + ridge)
    for j in range(x.shape[1]) if depth else ():
        order = np.argsort(x[:, j], kind="stable")
        v, g, h = x[order, j], np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if len(cut):
            gain = g[cut] ** 2 / (h[cut] + ridge) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + ridge) - parent
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    _, j, threshold = best
    if j is None:
        return leaf
    low = x[:, j] <= threshold
    return (j, threshold, fit_tree(x[low], grad[low], hess[low], depth - 1, least, ridge), fit_tree(x[~low], grad[~low], hess[~low], depth - 1, least, ridge))


def tree_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    j, threshold, low, high = tree
    return np.where(x[:, j] <= threshold, tree_values(low, x), tree_values(high, x))


class Boosted:
    """Logistic boosting. rate: the part of each step taken."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> None:
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start, self.rate, self.trees = math.log(mean / (1 - mean)), rate, []
        margin = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            tree = fit_tree(x, y - p, p * (1 - p), depth)
            self.trees.append(tree)
            margin += rate * tree_values(tree, x)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(tree_values(t, x) for t in self.trees)

    def column(self, features: list[Column]) -> Column:
        """The margin as an expression."""

        def value(tree: Tree) -> Column:
            if len(tree) == 1:
                return F.lit(self.rate * tree[0])
            return F.when(features[tree[0]] <= tree[1], value(tree[2])).otherwise(value(tree[3]))

        return reduce(lambda a, b: a + b, map(value, self.trees), F.lit(self.start))


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's a, b: P(1) = 1 / (1 + exp(-(a * margin + b))), by Newton's method on smoothed labels."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (t - p))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def threshold_for(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at which the precision is reached here, half-way to the next score below; above 1 (none) if nowhere."""
    order = np.argsort(-probability, kind="stable")
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(probability[order][1:] < probability[order][:-1], True)
    good = np.flatnonzero((hit >= precision) & last)
    if not len(good):
        return 2.0
    found = probability[order]
    return float((found[good[-1]] + found[min(good[-1] + 1, len(found) - 1)]) / 2)
