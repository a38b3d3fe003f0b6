"""Feature screening: missing share, one value, IV, AUC, PSI, correlation, VIF, best N; with every reason for each feature."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import is_numeric, long_form, without_nan
from .binning import BinTable, Settings, fit
from .drift import correlations, psi_of, vif
from .passes import MAIN, histograms, kept
from .profile import quick_iv, require_unique, value_counts

REASONS = ("missing", "one_value", "iv", "auc", "psi", "corr", "vif", "top_n")


class FeatureScreenWarning(UserWarning):
    pass


@dataclass(frozen=True)
class ScreenOutcome:
    stage: str
    support: tuple[str, ...]
    n_candidates: int | None
    min_required: int
    ok: bool
    message: str


@dataclass
class Screen:
    support: list[str]
    iv: dict[str, float]
    reasons: dict[str, list[str]]
    quality: DataFrame
    n_candidates: int
    measures: dict[str, dict[str, float]] = field(default_factory=dict)

    @property
    def exhausted(self) -> bool:
        return not self.support


def assess_screen(support: list[str], *, stage: str, n_candidates: int | None = None, min_required: int = 1) -> ScreenOutcome:
    """Whether enough features are left; warns, never raises."""
    ok = len(support) >= min_required
    message = "" if ok else f"{stage}: {len(support)} of {n_candidates if n_candidates is not None else '?'} features left, {min_required} needed"
    if not ok:
        warnings.warn(message, FeatureScreenWarning, stacklevel=2)
    return ScreenOutcome(stage, tuple(support), n_candidates, min_required, ok, message)


def missing_and_mode(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float | None]]:
    """column -> share of NULLs, and share of the most frequent value among others."""
    n = F.sum("n")
    valid = F.sum(F.when(F.col("known"), F.col("n")))
    mode = F.max(F.when(F.col("known"), F.col("n")))
    rows = value_counts(df, columns).groupBy("variable").agg((1 - F.coalesce(valid, F.lit(0)) / n), mode / valid).collect()
    return {v: (m, o) for v, m, o in rows}


def raw_auc(df: DataFrame, target: str, columns: list[str]) -> dict[str, float]:
    """AUC of each raw column, not mirrored; 0.5 where values are missing. All columns in one pass."""
    cells = long_form(df, {c: F.col(c).cast("double") for c in columns}, {"y": F.col(target)}).groupBy("variable", "value")
    cells = cells.agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    line = Window.partitionBy("variable").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    area = F.sum(F.col("bad") * (F.col("upto") - F.col("good") / 2)) / F.nullif(F.sum("bad") * F.sum("good"), F.lit(0))
    rows = cells.withColumn("upto", F.sum("good").over(line)).groupBy("variable").agg(area, F.count_if(F.col("value").isNull())).collect()
    return {v: 0.5 if a is None or nulls else a for v, a, nulls in rows}


def psi_left_closed(train: DataFrame, test: DataFrame, target: str, columns: list[str], tables: dict[str, BinTable] | None) -> dict[str, float]:
    """PSI of each column over bins [lo, hi) of the tables' cuts (ten frequency bins where there are none)."""
    known = {c: t for c, t in (tables or {}).items() if t.dtype == "numeric"}
    rest = [c for c in columns if c not in known]
    if rest:
        known |= {c: t for c, t in fit(train, target, rest, Settings(method="frequency", n_bins=10, adjust_shape=False)).items() if t.dtype == "numeric"}
    own = {c: F.col(c) for c in columns if c in known}
    cuts = {c: known[c].cuts for c in own}
    rows = []
    for side, sample in ((0, train), (1, test)):
        for c, cells in histograms(without_nan(sample), own, cuts, right=False).items():
            rows += [(c, r.at, r.n * (side == 0), r.n * (side == 1)) for r in cells if r.kind == MAIN]
    cells = train.sparkSession.createDataFrame(rows, "variable string, value double, expected long, actual long").groupBy("variable", "value")
    return dict(psi_of(cells.agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual")), ["variable"]).collect())


def screen(
    df: DataFrame, target: str, columns: list[str], *, test: DataFrame | None = None, tables: dict[str, BinTable] | None = None, max_missing_rate: float = 0.8,
    max_one_value_rate: float = 0.95, iv_range: tuple[float | None, float | None] = (0.02, None), min_auc: float | None = None, max_psi: float | None = None,
    max_corr: float | None = 0.7, max_vif: float | None = None, n_selected: int | None = None,
) -> Screen:
    """The features that pass all checks, in the order: missing, one value, IV, AUC, PSI, correlation, VIF, best N by IV.

    Limits are exceeded strictly; the IV range is inclusive. Of two correlated features that of lower IV goes (the second of equals); pairs are
    not looked at again after that. All features over the VIF limit go together. Each statistic is one pass for all features.
    """
    require_unique(columns, "features")
    if not columns:
        warnings.warn("no features to screen", FeatureScreenWarning, stacklevel=2)
    if max_psi is not None and test is None:
        warnings.warn("max_psi needs a test sample; the check is off", FeatureScreenWarning, stacklevel=2)
        max_psi = None
    with kept(df, without_nan(df).select(*dict.fromkeys([*columns, target]))) as held:
        return _screen(held, target, columns, test, tables, max_missing_rate, max_one_value_rate, iv_range, min_auc, max_psi, max_corr, max_vif, n_selected)


def _screen(df, target, columns, test, tables, max_missing_rate, max_one_value_rate, iv_range, min_auc, max_psi, max_corr, max_vif, n_selected) -> Screen:
    spark = df.sparkSession
    shares = missing_and_mode(df, columns) if columns else {}
    quick = [c for c in columns if c not in (tables or {})]
    iv = {c: t.iv_total for c, t in (tables or {}).items() if c in columns} | (dict(quick_iv(df, target, quick).collect()) if quick else {})
    numeric = [c for c in columns if is_numeric(df, c)]
    auc = raw_auc(df, target, numeric) if min_auc is not None else {}
    psi = psi_left_closed(df, test, target, numeric, tables) if max_psi is not None else {}
    low, high = iv_range
    reasons: dict[str, list[str]] = {c: [] for c in columns}
    for c in columns:
        missing, mode = shares.get(c, (1.0, None))
        checks = {
            "missing": missing > max_missing_rate, "one_value": mode is not None and mode > max_one_value_rate,
            "iv": (low is not None and iv.get(c, 0.0) < low) or (high is not None and iv.get(c, 0.0) > high),
            "auc": c in auc and auc[c] < min_auc, "psi": psi.get(c) is not None and max_psi is not None and psi[c] > max_psi,
        }
        reasons[c] = [k for k, failed in checks.items() if failed]
    left = [c for c in columns if not reasons[c]]
    if max_corr is not None:
        pairs = correlations(df, [c for c in left if c in numeric], max_corr).where(F.col("corr") > max_corr).collect()
        order = {c: i for i, c in enumerate(columns)}
        for a, b, _ in sorted(pairs, key=lambda p: (order[p[0]], order[p[1]])):
            loser = a if iv.get(a, 0.0) < iv.get(b, 0.0) else b
            if "corr" not in reasons[loser]:
                reasons[loser].append("corr")
        left = [c for c in left if not reasons[c]]
    if max_vif is not None:
        for c, v, _ in vif(df, [c for c in left if c in numeric], max_vif).collect():
            if v > max_vif:
                reasons[c].append("vif")
        left = [c for c in left if not reasons[c]]
    if n_selected is not None:
        best = sorted(left, key=lambda c: (-iv.get(c, 0.0), c))[:n_selected]
        for c in left:
            if c not in best:
                reasons[c].append("top_n")
        left = best
    rows = [
        (c, round(shares.get(c, (1.0, None))[0], 6), None if shares.get(c, (1, None))[1] is None else round(shares[c][1], 6), round(iv.get(c, 0.0), 6),
         "bin_table" if c in (tables or {}) else "equalfreq", c in left, c not in left, ";".join(reasons[c]))
        for c in columns
    ]
    schema = "feature string, missing_rate double, one_value_rate double, iv double, iv_source string, selected boolean, dropped boolean, reason string"
    return Screen(left, iv, reasons, spark.createDataFrame(rows, schema), len(columns), {"auc": auc, "psi": psi})
