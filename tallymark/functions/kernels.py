"""Merging of small histograms: pure functions on lists of [right edge, bad, good], a few dozen rows for each variable."""

from __future__ import annotations

import math

import numpy as np

INF = float("inf")
WOE_FLOOR, WOE_ALL_BAD = -2.0, 20.0  # fixed values
TREND_CODES = {
    None: 0, False: 0, 0: 0, True: 1, 1: 1, "increasing": 1, "ascending": 1, -1: 2, 2: 2, "decreasing": 2, "descending": 2,
    3: 3, "u": 3, "valley": 3, 4: 4, "inverted_u": 4, "inverted-u": 4, "inverted u": 4, "peak": 4,
}
TREND_NAMES = {0: "none", 1: "increasing", 2: "decreasing", 3: "U-shape", 4: "inverted-U"}

Row = list
"""[right edge, bad, good]"""


def trend_code(trend: object) -> int:
    """0 none, 1 increasing, 2 decreasing, 3 U-shape, 4 inverted U."""
    key = trend.lower() if isinstance(trend, str) else trend
    if key not in TREND_CODES:
        raise ValueError(f"unknown trend: {trend!r}")
    return TREND_CODES[key]


def rate(row: Row) -> float:
    return row[1] / (row[1] + row[2]) if row[1] + row[2] else 0.0


def merge_at(rows: list[Row], i: int) -> list[Row]:
    """Rows i and i + 1 as one."""
    a, b = rows[i], rows[i + 1]
    return [*rows[:i], [b[0], a[1] + b[1], a[2] + b[2]], *rows[i + 2 :]]


def chi2(a: Row, b: Row) -> float:
    """Pearson's statistic of two rows; 0 without rows, infinite if a margin is empty."""
    n = a[1] + a[2] + b[1] + b[2]
    if n == 0:
        return 0.0
    below = (a[1] + a[2]) * (b[1] + b[2]) * (a[1] + b[1]) * (a[2] + b[2])
    return (a[1] * b[2] - a[2] * b[1]) ** 2 * n / below if below > 0 else INF


def merge_one_class_runs(rows: list[Row]) -> list[Row]:
    """Neighbours that lack the same class become one row, from left to right."""
    i = 0
    while i < len(rows) - 1:
        lacking = next((k for k in (2, 1) if rows[i][k] == 0 and rows[i + 1][k] == 0), None)
        if lacking is None:
            i += 1
        else:
            rows = merge_at(rows, i)
    return rows


def chi_merge(rows: list[Row], n_bins: int, confidence: float = 3.841) -> list[Row]:
    """Merges the first neighbours of least chi-square until n_bins are left or all differ with confidence."""
    if sum(r[1] for r in rows) == 0 or sum(r[2] for r in rows) == 0:
        return [[INF, sum(r[1] for r in rows), sum(r[2] for r in rows)]] if rows else rows
    rows = merge_one_class_runs([r for r in rows if r[1] + r[2]])
    while len(rows) > n_bins:
        values = [chi2(a, b) for a, b in zip(rows, rows[1:], strict=False)]
        i = min(range(len(values)), key=values.__getitem__)
        if values[i] >= confidence:
            break
        rows = merge_at(rows, i)
    return rows


def woe_iv(rows: list[Row]) -> list[tuple[float, float]]:
    """Weight of evidence and information value of each row."""
    bad, good = sum(r[1] for r in rows), sum(r[2] for r in rows)
    out = []
    for _, b, g in rows:
        if bad == 0 or good == 0 or b + g == 0:
            woe = 0.0
        elif g == 0:
            woe = WOE_ALL_BAD
        elif b == 0:
            woe = WOE_FLOOR
        else:
            woe = max(WOE_FLOOR, math.log((b / bad) / (g / good)))
        out.append((woe, (b / bad - g / good) * woe if bad and good else 0.0))
    return out


def monotone(rates: list[float]) -> int:
    """1 if the rates never fall, 2 if they never rise, else 0; flat rates count as rising."""
    if len(rates) < 2:
        return 0
    steps = [b - a for a, b in zip(rates, rates[1:], strict=False)]
    return 1 if min(steps) >= 0 else 2 if max(steps) <= 0 else 0


def u_shape(rows: list[Row], side_bins: float = 0.2, side_share: float = 0.2, ends_apart: float = 0.5) -> int:
    """3 for a valley, 4 for a peak, else 0: the turn lies in the middle, both sides are monotone and large, the ends are close.

    The least rate is the turn if it lies in the middle, else the highest one: where the former is no valley, no peak is looked for.
    """
    n, rates = len(rows), [rate(r) for r in rows]
    if n < 3:
        return 0
    total, span = sum(r[1] + r[2] for r in rows), max(rates) - min(rates)
    margin = max(1, int(n * side_bins))
    for code, turn in ((3, rates.index(min(rates))), (4, rates.index(max(rates)))):
        if not margin <= turn < n - margin:
            continue
        left, right = rates[: turn + 1], rates[turn:]
        want = (2, 1) if code == 3 else (1, 2)
        falls = lambda side, way: all((b - a) * (1 if way == 1 else -1) >= 0 for a, b in zip(side, side[1:], strict=False))
        shares = [sum(r[1] + r[2] for r in side) / total for side in (rows[:turn], rows[turn + 1 :])]
        if falls(left, want[0]) and falls(right, want[1]) and min(shares) >= side_share and span > 0 and abs(rates[0] - rates[-1]) / span <= ends_apart:
            return code
        return 0
    return 0


def trend_of(rows: list[Row]) -> int:
    return monotone([rate(r) for r in rows]) or u_shape(rows)


def pair_to_merge(trend: int, steps: list[float]) -> int:
    """Which neighbours to merge to come nearer a trend: the smallest step against it; for a U, a wrong end first."""
    smallest = min(range(len(steps)), key=lambda i: abs(steps[i]))
    if trend in (1, 2):
        against = [i for i, s in enumerate(steps) if (s < 0 if trend == 1 else s > 0)]
        return min(against, key=lambda i: abs(steps[i])) if against else smallest
    if trend in (3, 4):
        sign = 1 if trend == 3 else -1
        if steps[0] * sign > 0:
            return 0
        if steps[-1] * sign < 0:
            return len(steps) - 1
    return smallest


def adjust(rows: list[Row], total: int, min_share: float = 0.05, min_woe: float = 0.1, trend: int = 0) -> tuple[list[Row], int]:
    """Merges small rows, then rows against the trend, then rows of close weight of evidence; the trend found before the last."""
    rows = [list(r) for r in rows]
    while len(rows) > 2:
        sizes = [r[1] + r[2] for r in rows]
        i = min(range(len(rows)), key=sizes.__getitem__)
        if sizes[i] >= min_share * total:
            break
        if i == 0:
            j = 0
        elif i == len(rows) - 1:
            j = i - 1
        else:
            j = i - 1 if abs(rate(rows[i]) - rate(rows[i - 1])) <= abs(rate(rows[i + 1]) - rate(rows[i])) else i
        rows = merge_at(rows, j)
    while trend and len(rows) > 2:
        rates = [rate(r) for r in rows]
        steps = [b - a for a, b in zip(rates, rates[1:], strict=False)]
        if not any(steps) or (monotone(rates) == trend if trend < 3 else u_shape(rows) == trend):
            break
        rows = merge_at(rows, pair_to_merge(trend, steps))
    found = trend_of(rows)
    while len(rows) > 2:
        woes = [w for w, _ in woe_iv(rows)]
        gaps = [abs(b - a) for a, b in zip(woes, woes[1:], strict=False)]
        i = min(range(len(gaps)), key=gaps.__getitem__)
        if gaps[i] >= min_woe:
            break
        rows = merge_at(rows, i)
    return rows, found


def rate_merge(levels: list[tuple[str, int, int]], min_share: float = 0.05, gap: float = 0.05) -> list[list[str]]:
    """Groups of category levels (level, bad, good) in order of bad rate: a level joins the group before it if that is small or close."""
    total = sum(b + g for _, b, g in levels)
    order = sorted(levels, key=lambda x: (x[1] / (x[1] + x[2]), x[0]))
    groups: list[list] = []
    for level, bad, good in order:
        if groups:
            names, b, g = groups[-1]
            if (b + g) < min_share * total or abs(bad / (bad + good) - b / (b + g)) < gap:
                groups[-1] = [[*names, level], b + bad, g + good]
                continue
        groups.append([[level], bad, good])
    return [names for names, _, _ in groups]


def frequency_merge(levels: list[tuple[str, int, int]], top: int = 10) -> list[list[str]]:
    """Each of the most frequent levels for itself, the others together where there are more than `top`."""
    order = [x for x, _, _ in sorted(levels, key=lambda x: (-(x[1] + x[2]), x[0]))]
    return [[x] for x in order] if len(order) <= top else [*([x] for x in order[: top - 1]), order[top - 1 :]]


def missing_target(bins: list[tuple[int, int]], missing: tuple[int, int], how: str) -> int:
    """Which bin (bad, good) takes the missing rows: of nearest bad rate ("near") or of the highest ("worst"); the first of equals."""
    rates = [b / (b + g) if b + g else None for b, g in bins]
    if how == "worst":
        return max(range(len(bins)), key=lambda i: (-INF if rates[i] is None else rates[i], -i))
    own = missing[0] / sum(missing)
    return min(range(len(bins)), key=lambda i: (INF if rates[i] is None else abs(rates[i] - own), i))


def tree_cuts(rows: list[Row], max_leaves: int | None = None, max_depth: int | None = None, least: int = 1) -> list[float]:
    """Thresholds of a one-feature Gini tree on a histogram; row[0] is the value.

    With max_leaves it grows best first, with max_depth level by level. Thresholds are midpoints; the first of equal gains wins.
    """
    value = np.array([r[0] for r in rows], float)
    bad, good = (np.cumsum([0, *(r[k] for r in rows)]) for k in (1, 2))

    def impurity(b: np.ndarray, g: np.ndarray) -> np.ndarray:
        n = b + g
        return np.where(n > 0, 2.0 * b * g / np.maximum(n, 1), 0.0)

    def best(lo: int, hi: int) -> tuple[float, int]:
        at = np.arange(lo + 1, hi)
        if not len(at):
            return 0.0, -1
        lb, lg, rb, rg = bad[at] - bad[lo], good[at] - good[lo], bad[hi] - bad[at], good[hi] - good[at]
        gain = impurity(bad[hi] - bad[lo], good[hi] - good[lo]) - impurity(lb, lg) - impurity(rb, rg)
        gain = np.where((lb + lg >= least) & (rb + rg >= least), gain, -1.0)
        i = int(np.argmax(gain))
        return (float(gain[i]), int(at[i])) if gain[i] > 1e-12 else (0.0, -1)

    leaves, cuts = [(0, len(rows), 0)], []
    while max_leaves is None or len(leaves) < max_leaves:
        options = [(*best(lo, hi), k) for k, (lo, hi, depth) in enumerate(leaves) if max_depth is None or depth < max_depth]
        options = [o for o in options if o[1] >= 0]
        if not options:
            break
        _, at, k = max(options, key=lambda o: (o[0], -o[2]))
        lo, hi, depth = leaves.pop(k)
        leaves += [(lo, at, depth + 1), (at, hi, depth + 1)]
        cuts.append(float((value[at - 1] + value[at]) / 2))
    return sorted(cuts)


def vifs(corr: np.ndarray) -> list[float]:
    """1 / (1 - R^2) of each variable on the others, from their correlations; infinite for a linear function of the others.

    Directions of the others that hardly vary (by 1e-10) are left out, since rounding decides what a regression says of them.
    """
    out = []
    for i in range(len(corr)):
        others = np.arange(len(corr)) != i
        r = corr[others, i]
        rest = 1 - float(r @ np.linalg.pinv(corr[np.ix_(others, others)], rcond=1e-10, hermitian=True) @ r) if others.any() else 1.0
        out.append(1 / rest if rest > 1e-10 else INF)
    return out
