"""Merging kernels, trees and the logit against plain restatements and known answers."""

import math
import random

import numpy as np
import pytest

from tallymark.functions import kernels as K
from tallymark.functions.logit import fit_logit, ks_auc


def rows(seed, n=12, top=40):
    r = random.Random(seed)
    return [[float(i), r.randint(0, top), r.randint(0, top)] for i in range(n)]


def totals(x):
    return sum(r[1] for r in x), sum(r[2] for r in x)


@pytest.mark.parametrize("seed", range(20))
def test_merges_keep_counts_and_edges(seed):
    own = rows(seed)
    for out in (K.chi_merge(own, 4), K.adjust(own, sum(totals(own)), trend=seed % 5)[0], K.merge_one_class_runs(own)):
        assert totals(out) == totals(own)
        assert [r[0] for r in out] == sorted(r[0] for r in out) and {r[0] for r in out} <= {r[0] for r in own}


def test_chi_merge_stops_where_neighbours_differ():
    own = [[1.0, 10, 90], [2.0, 11, 89], [3.0, 60, 40], [4.0, 61, 39]]
    assert [r[0] for r in K.chi_merge(own, 2)] == [2.0, 4.0]
    assert len(K.chi_merge(own, 1)) == 2  # what is left differs with confidence
    assert K.chi2([0, 1, 2], [0, 1, 2]) == 0 and K.chi2([0, 0, 5], [0, 0, 7]) == math.inf and K.chi2([0, 0, 0], [0, 0, 0]) == 0


def test_woe_limits():
    found = K.woe_iv([[1, 5, 0], [2, 0, 5], [3, 0, 0], [4, 5, 5]])
    assert [w for w, _ in found][:3] == [K.WOE_ALL_BAD, K.WOE_FLOOR, 0.0]
    assert [w for w, _ in K.woe_iv([[1, 5, 0], [2, 3, 0]])] == [0.0, 0.0]
    woe, iv = K.woe_iv([[1, 30, 10], [2, 10, 30]])[0]
    assert math.isclose(woe, math.log(3)) and math.isclose(iv, 0.5 * math.log(3))


def test_trends():
    assert [K.monotone(x) for x in ([0.1, 0.2, 0.2], [0.3, 0.2], [0.1, 0.1], [0.1], [0.1, 0.3, 0.2])] == [1, 2, 1, 0, 0]
    valley = [[i, b, 100 - b] for i, b in enumerate([40, 20, 10, 20, 38])]
    assert K.u_shape(valley) == 3 and K.u_shape([[i, 100 - b, b] for i, b, _ in valley]) == 4
    assert K.u_shape([[i, b, 100 - b] for i, b in enumerate((50, 90, 10, 10))]) == 0
    with pytest.raises(ValueError):
        K.trend_code("sideways")
    out, code = K.adjust([[i, b, 100 - b] for i, b in enumerate([10, 30, 20, 50, 40, 70])], 600, min_woe=0.0, trend=1)
    assert code == 1 and K.monotone([K.rate(r) for r in out]) == 1


def brute_best_cut(own, least):
    gini = lambda b, g: 2 * b * g / (b + g) if b + g else 0
    best = (1e-12, None)
    for i in range(1, len(own)):
        (lb, lg), (rb, rg) = totals(own[:i]), totals(own[i:])
        gain = gini(lb + rb, lg + rg) - gini(lb, lg) - gini(rb, rg)
        if min(lb + lg, rb + rg) >= least and gain > best[0] + 1e-12:
            best = (gain, (own[i - 1][0] + own[i][0]) / 2)
    return best[1]


@pytest.mark.parametrize("seed", range(10))
def test_first_tree_cut_is_the_best(seed):
    own = rows(seed, 20)
    cut = K.tree_cuts(own, max_leaves=2, least=5)
    assert cut == [c for c in [brute_best_cut(own, 5)] if c is not None]
    assert len(K.tree_cuts(own, max_leaves=5)) <= 4 and len(K.tree_cuts(own, max_depth=3)) <= 7


def test_category_merges():
    levels = [("a", 1, 99), ("b", 2, 98), ("c", 50, 50), ("d", 52, 48)]
    assert K.rate_merge(levels) == [["a", "b"], ["c", "d"]]
    assert K.frequency_merge([("a", 1, 9), ("b", 2, 2), ("c", 1, 1)], 2) == [["a"], ["b", "c"]]
    assert K.missing_target([(1, 9), (5, 5), (9, 1)], (0, 4), "near") == 0 and K.missing_target([(1, 9), (5, 5), (9, 1)], (0, 4), "worst") == 2


def test_logit_solves_its_equations():
    r = np.random.default_rng(0)
    x, n = r.normal(size=(200, 3)), r.integers(1, 50, 200).astype(float)
    bad = r.binomial(n.astype(int), 1 / (1 + np.exp(-(x @ [0.5, -1, 0.2] - 1)))).astype(float)
    model = fit_logit(["a", "b", "c"], x, bad, n)
    left = bad - n / (1 + np.exp(-model.margin(x)))
    assert model.converged and abs(left.sum()) < 1e-6 and np.abs(x.T @ left).max() < 1e-6
    assert model.p_values["b"] < 1e-6 and abs(model.coef["b"] + 1) < 0.1
    assert fit_logit(["a", "b"], np.column_stack([x[:, 0], x[:, 0]]), bad, n) is None


def test_ks_auc_by_pairs():
    r = random.Random(1)
    score = np.array([r.randint(0, 5) for _ in range(80)], float)
    bad = np.array([r.random() < 0.1 + s / 10 for s in score], float)
    ks, auc = ks_auc(score, bad, np.ones(80))
    pairs = [(a > b) + (a == b) / 2 for a, x in zip(score, bad) for b, y in zip(score, bad) if x == 1 and y == 0]
    assert math.isclose(auc, sum(pairs) / len(pairs))
    shares = [abs((score[bad == 1] <= s).mean() - (score[bad == 0] <= s).mean()) for s in set(score)]
    assert math.isclose(ks, max(shares))
    assert ks_auc(score, np.ones(80), np.ones(80)) == (0.0, 0.5)
