"""Weighted logistic regression on compressed rows, with standard errors and p-values."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Logit:
    names: list[str]
    params: np.ndarray
    """Intercept first."""
    errors: np.ndarray
    converged: bool

    @property
    def intercept(self) -> float:
        return float(self.params[0])

    @property
    def coef(self) -> dict[str, float]:
        return dict(zip(self.names, map(float, self.params[1:]), strict=True))

    @property
    def p_values(self) -> dict[str, float]:
        """Two-sided, of the normal approximation."""
        z = np.abs(self.params[1:] / self.errors[1:])
        return {n: math.erfc(x / math.sqrt(2)) for n, x in zip(self.names, z, strict=True)}

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.params[0] + x @ self.params[1:]


def information(x: np.ndarray, bad: np.ndarray, n: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The information matrix and the slope of the log likelihood at beta; both add up over parts of the rows."""
    design = np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
    return design.T @ (design * (n * p * (1 - p))[:, None]), design.T @ (bad - n * p)


def fit_logit(names: list[str], x: np.ndarray, bad: np.ndarray, n: np.ndarray, rounds: int = 100) -> Logit | None:
    """Newton's method; x: one row per combination of values, bad of n rows in it. None if the information is singular."""
    return newton(names, lambda beta: information(x, bad, n, beta), rounds)


def newton(names: list[str], sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], rounds: int = 100) -> Logit | None:
    """Newton's method; sums: information and slope over all rows at given parameters."""
    beta = np.zeros(len(names) + 1)
    converged = False
    for _ in range(rounds):
        info, slope = sums(beta)
        try:
            step = np.linalg.solve(info, slope)
        except np.linalg.LinAlgError:
            return None
        if not np.isfinite(step).all():
            return None
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            converged = True
            break
    try:
        cov = np.linalg.inv(info)
    except np.linalg.LinAlgError:
        return None
    if not (np.diag(cov) > 0).all():
        return None
    return Logit(list(names), beta, np.sqrt(np.diag(cov)), converged)


def ks_auc(margin: np.ndarray, bad: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """KS and AUC of weighted rows; ties count one half. 0 and 0.5 with one class."""
    values, place = np.unique(margin, return_inverse=True)
    b, t = np.bincount(place, bad, len(values)), np.bincount(place, n, len(values))
    g = t - b
    if b.sum() == 0 or g.sum() == 0:
        return 0.0, 0.5
    cb, cg = np.cumsum(b), np.cumsum(g)
    ks = float(np.abs(cb / b.sum() - cg / g.sum()).max())
    return ks, float((b * (cg - g / 2)).sum() / (b.sum() * g.sum()))
