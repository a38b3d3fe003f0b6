"""Quality of each column by itself: IV, and AUC and KS of a small tree on it, PSI against a test sample."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import without_nan
from ..functions.logit import ks_auc
from .drift import psi_table
from .passes import kept
from .profile import quick_iv, roles, value_counts
from .trees import grow

ESTIMATORS = {"dt": "dt", "tree": "dt", "decisiontree": "dt", "xgb": "xgb", "xgboost": "xgb", "lgb": "lgb", "lightgbm": "lgb"}
TREE_DEPTH, LEAF, MIN_ROWS = 3, 5, 10


def estimator_name(name: str) -> str:
    """dt, xgb or lgb, from any of their names; xgb and lgb need packages that are not part of this engine."""
    key = name.lower().replace("-", "").replace("_", "")
    if key not in ESTIMATORS:
        raise ValueError(f"estimator {name!r} is none of {sorted(ESTIMATORS)}")
    if ESTIMATORS[key] != "dt":
        raise ImportError(f"{ESTIMATORS[key]} is not available; use dt")
    return "dt"


def list_supported_estimators() -> list[str]:
    return sorted(set(ESTIMATORS.values()))


def single_feature_scores(df: DataFrame, target: str, columns: list[str]) -> dict[str, tuple[float, float]]:
    """column -> AUC and signed KS of a tree of depth 3 fitted and measured on the same rows, NULLs left out; none of a column with
    fewer than 10 rows, one value or one class."""
    out = {}
    trees = grow(df.where(F.col(target).isNotNull()), target, {c: F.col(c) for c in columns}, dict.fromkeys(columns, LEAF), max_depth=TREE_DEPTH)
    for c, leaves in trees.items():
        bad = np.array([leaf.bad for leaf in leaves], float)
        total = np.array([leaf.bad + leaf.good for leaf in leaves], float)
        if total.sum() < MIN_ROWS or bad.sum() in (0, total.sum()) or leaves[0].least == leaves[0].largest:
            continue
        p = bad / total
        values, place = np.unique(p, return_inverse=True)
        b, t = np.bincount(place, bad), np.bincount(place, total)
        lead = np.cumsum(b) / b.sum() - np.cumsum(t - b) / (t - b).sum()
        out[c] = ks_auc(p, bad, total)[1], float(lead.max())
    return out


def quality(df: DataFrame, target: str, columns: list[str], test: DataFrame | None = None, estimator: str = "dt", compute_ks: bool = True, warn_insample_bias: bool = False) -> DataFrame:
    """variable, dtype, iv, auc, ks, psi (6 digits), missing_pct, n_unique, by IV. AUC and KS of numbers only, psi with a test sample only."""
    estimator_name(estimator)
    if test is not None and (absent := [c for c in columns if c not in test.columns]):
        raise ValueError(f"the test sample lacks {absent}")
    if warn_insample_bias:
        warnings.warn("AUC and KS are measured on the rows that the trees are fitted on", stacklevel=2)
    with kept(df, without_nan(df).select(*columns, target)) as held:
        return _quality(held, target, columns, test, compute_ks)


def _quality(df: DataFrame, target: str, columns: list[str], test: DataFrame | None, compute_ks: bool) -> DataFrame:
    own, iv = roles(df, columns), dict(quick_iv(df, target, columns).collect())
    scores = single_feature_scores(df, target, [c for c in columns if own[c] == "numeric"])
    psi = dict(psi_table(df, test, columns).collect()) if test is not None else {}
    missing = F.round(100.0 * F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)) / F.sum("n"), 2)
    counts = {r[0]: (r[1], r[2]) for r in value_counts(df, columns).groupBy("variable").agg(missing, F.count_if("known")).collect()}
    rounded = lambda v: None if v is None else round(v, 6)
    rows = [(c, own[c], rounded(iv.get(c)), rounded(scores[c][0]) if c in scores else None, rounded(scores[c][1]) if c in scores and compute_ks else None, rounded(psi.get(c)), *counts[c]) for c in columns]
    rows.sort(key=lambda r: (-(r[2] or 0.0), r[0]))
    return df.sparkSession.createDataFrame(rows, "variable string, dtype string, iv double, auc double, ks double, psi double, missing_pct double, n_unique long")
