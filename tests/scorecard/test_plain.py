"""Queries that SQL cannot express against plain versions over all rows: numpy, and the kernels on a histogram counted in Python."""

import math
import warnings

import numpy as np
import pytest

from tallymark.functions import kernels as K
from tallymark.plans import catalog
from tallymark.plans.loans import FEATURES, NUMERIC, SPECIALS, loans


@pytest.fixture(scope="module")
def rows(spark, sf):
    return loans(spark, sf).toPandas()


def got(spark, sf, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return catalog.QUERIES[name](spark, sf).collect()


def counted(x, y, cuts):
    """[right edge, bad, good] of the bins (lo, hi] that have values."""
    place = np.searchsorted(cuts, x, side="left")
    return [[[*cuts, K.INF][i], int(y[place == i].sum()), int((1 - y[place == i]).sum())] for i in np.unique(place)]


def main_bins(rows, name, found):
    x, y = rows[name].to_numpy(float), rows["bad"].to_numpy()
    clean = ~np.isnan(x) & ~np.isin(x, SPECIALS)
    return found(x[clean], y[clean])


def by_chi(x, y):
    values = np.unique(x)
    cuts = values[:-1] if len(values) <= 50 else np.unique(np.quantile(x, np.arange(51) / 50))[1:-1]
    rows = counted(x, y, cuts)
    if len(values) <= 50:
        rows = [[v, *r[1:]] for v, r in zip(values, rows)]
    return K.chi_merge(rows, 5)


def by_tree(x, y):
    points = [[v, int(y[x == v].sum()), int((1 - y[x == v]).sum())] for v in np.unique(x)]
    return counted(x, y, np.array(K.tree_cuts(points, max_leaves=5, least=max(1, int(0.01 * len(x))))))


@pytest.mark.parametrize("name, method", [("bin_chi", by_chi), ("bin_tree", by_tree)])
def test_bins(spark, sf, rows, name, method):
    own = [r for r in got(spark, sf, name) if r.kind == "main"]
    for c in NUMERIC:
        if len(np.unique(rows[c].dropna())) <= 20:
            continue  # categories
        merged = main_bins(rows, c, method)
        merged[-1][0] = K.INF
        want, _ = K.adjust(merged, len(rows), 0.05, 0.1, 0)
        assert [(r.count_bad, r["count"] - r.count_bad) for r in own if r.variable == c] == [(b, g) for _, b, g in want], c


def plain_logit(rows):
    """Weights of evidence by row and Newton's method over all rows."""
    bad = rows["bad"].to_numpy(float)
    keys = {}
    qty = rows["qty"].to_numpy(float)
    keys["qty"] = np.where(np.isnan(qty), 100, np.where(qty == -999, 99, np.searchsorted(catalog.QTY_CUTS, np.nan_to_num(qty))))
    for c in ("disc", "tax"):
        keys[c] = rows[c].astype(str).to_numpy()
    design = [np.ones(len(rows))]
    for c in catalog.SMALL:
        woe = np.zeros(len(rows))
        for k in np.unique(keys[c]):
            at = keys[c] == k
            b, g = bad[at].sum(), (1 - bad[at]).sum()
            value = 20.0 if g == 0 else -2.0 if b == 0 else max(-2.0, math.log((b / bad.sum()) / (g / (1 - bad).sum())))
            woe[at] = round(value, 6)
        design.append(woe)
    x, beta = np.column_stack(design), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (bad - p))
    return x, beta


def test_logit_points_and_scores(spark, sf, rows):
    x, beta = plain_logit(rows)
    found = {r.variable: r.coef for r in got(spark, sf, "logit_coefficients")}
    assert [found[c] for c in ("const", *catalog.SMALL)] == pytest.approx(beta, abs=2e-6)
    factor = 10 / math.log(2)
    points = got(spark, sf, "scorecard_points")
    for r in points:
        assert r.points == pytest.approx(-factor * beta[1 + catalog.SMALL.index(r.variable)] * r.woe, abs=0.0051)
    score = np.round(600 + factor * (math.log(50) + beta[0]) - factor * (x[:, 1:] @ beta[1:]), 2)
    own = got(spark, sf, "scorecard_predict")
    assert sum(r.n for r in own) == len(rows) and sum(r.bad for r in own) == rows["bad"].sum()
    assert np.allclose(np.repeat([r.score for r in sorted(own)], [r.n for r in sorted(own)]), np.sort(score), atol=0.011)


def test_vif_filter(spark, sf, rows):
    x = np.column_stack([rows["price"], rows["price"] + rows["disc"] / 100, rows["disc"], rows["total"]])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    kept = []
    for i in range(4):  # regressions on the rows; a direction of the others with next to no variance says nothing
        others = np.delete(z, i, axis=1)
        left = z[:, i] - others @ np.linalg.lstsq(others, z[:, i], rcond=1e-5)[0]
        kept.append(bool(left.var() > 0.1))
    assert kept == [False, False, True, True]
    assert [r.selected for r in got(spark, sf, "filter_vif")] == kept


def test_single_feature_quality(spark, sf, rows):
    train = rows[rows["yr"] <= 1998]
    found = {r.variable: r for r in got(spark, sf, "quality_single_var")}
    assert set(found) == set(FEATURES)
    for c in ("qty", "price", "total"):
        own = train[train[c].notna()]
        x, y = own[c].to_numpy(float), own["bad"].to_numpy()
        points = [[v, int(y[x == v].sum()), int((1 - y[x == v]).sum())] for v in np.unique(x)]
        leaves = counted(x, y, np.array(K.tree_cuts(points, max_depth=3, least=5)))
        p = np.concatenate([np.full(b + g, b / (b + g)) for _, b, g in leaves])
        label = np.concatenate([[1] * b + [0] * g for _, b, g in leaves])
        order = np.argsort(p, kind="stable")
        ranks = np.empty(len(p))
        for v in np.unique(p):
            at = np.flatnonzero(p[order] == v)
            ranks[order[at]] = at.mean() + 1
        n1 = label.sum()
        auc = (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))
        assert found[c].auc == pytest.approx(auc, abs=1e-6)
