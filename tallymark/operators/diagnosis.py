"""Diagnosis of a model from its small result tables: issues by level, with evidence and a suggestion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .binning import BinTable

LEVELS = ("critical", "warning", "info")
# The default limits.
LIMITS = {
    "discrimination": {"ks_critical": 0.15, "ks_warning": 0.20, "ks_info": 0.30, "ks_high": 0.60, "auc_critical": 0.60, "auc_warning": 0.70, "auc_high": 0.95},
    "overfitting": {"critical": 0.30, "warning": 0.15, "info": 0.10, "max_vars": 12},
    "stability": {"psi_critical": 0.25, "psi_warning": 0.10, "decay_critical": 0.30, "decay_warning": 0.15, "auc_loss": 0.20, "culprit": 0.15},
    "variables": {"missing_critical": 0.50, "missing_warning": 0.30, "iv_high": 0.50, "iv_low": 0.02, "min_strong": 3},
    "target": {"min_bad_rate": 0.02},
}


@dataclass(frozen=True)
class Issue:
    level: str
    category: str
    title: str
    evidence: str
    suggestion: str
    culprits: tuple[str, ...] = ()


@dataclass
class Report:
    issues: list[Issue] = field(default_factory=list)

    def of(self, level: str) -> list[Issue]:
        return [i for i in self.issues if i.level == level]

    critical = property(lambda self: self.of("critical"))
    warnings = property(lambda self: self.of("warning"))
    infos = property(lambda self: self.of("info"))

    def __bool__(self) -> bool:
        return bool(self.issues)

    def __str__(self) -> str:
        return "\n".join(f"[{i.level}] {i.category}: {i.title} ({i.evidence}). {i.suggestion}" for level in LEVELS for i in self.of(level)) or "no issues"

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i.level, i.category, i.title, i.evidence, i.suggestion, list(i.culprits)) for i in self.issues]
        return spark.createDataFrame(rows, "level string, category string, title string, evidence string, suggestion string, culprit_vars array<string>")


def limits(own: dict[str, dict] | None = None) -> dict[str, dict]:
    """The defaults with one's own limits over them; unknown categories are ignored."""
    return {k: v | (own or {}).get(k, {}) for k, v in LIMITS.items()}


def diagnose(
    result: dict | None = None, *, tables: dict[str, BinTable] | None = None, coef: dict[str, float] | None = None, psi_by_variable: dict[str, float] | None = None,
    bad_rate: float | None = None, missing: dict[str, float] | None = None, own_limits: dict[str, dict] | None = None,
) -> Report:
    """result: as evaluate() gives (trn_ks, test_ks, oot_ks, trn_auc, ..., psi, psi_oot, n_vars); without it, the checks before a model."""
    at, out = limits(own_limits), []

    def add(level: str | None, *rest: object) -> None:
        if level:
            out.append(Issue(level, *rest))

    def above(value: float | None, steps: list[tuple[float, str]]) -> str | None:
        return None if value is None else next((level for limit, level in steps if value > limit), None)

    tables = tables or {}
    if result:
        d, o, s = at["discrimination"], at["overfitting"], at["stability"]
        ks, auc = result.get("test_ks", result.get("trn_ks")), result.get("test_auc", result.get("trn_auc"))
        low = next((level for limit, level in ((d["ks_critical"], "critical"), (d["ks_warning"], "warning"), (d["ks_info"], "info")) if ks is not None and ks < limit), None)
        add(low, "discrimination", "low KS", f"KS {ks}", "look for stronger features")
        add(above(ks, [(d["ks_high"], "info")]), "discrimination", "very high KS", f"KS {ks}", "check for leakage")
        low = next((level for limit, level in ((d["auc_critical"], "critical"), (d["auc_warning"], "warning")) if auc is not None and auc < limit), None)
        add(low, "discrimination", "low AUC", f"AUC {auc}", "look for stronger features")
        add(above(auc, [(d["auc_high"], "info")]), "discrimination", "very high AUC", f"AUC {auc}", "check for leakage")
        if result.get("test_ks") is not None and result.get("trn_ks"):
            loss = (result["trn_ks"] - result["test_ks"]) / result["trn_ks"]
            level = above(loss, [(o["critical"], "critical"), (o["warning"], "warning"), (o["info"], "info")])
            add(level, "overfitting", "KS falls from train to test", f"loss {loss:.4f}", "use fewer or coarser features")
            if level and result.get("n_vars", 0) > o["max_vars"]:
                add("info", "overfitting", "many variables", f"{result['n_vars']} variables", "use fewer features")
        culprits = tuple(c for c, v in sorted((psi_by_variable or {}).items(), key=lambda x: (-x[1], x[0])) if v > s["culprit"])[:3]
        for k in ("psi", "psi_oot"):
            add(above(result.get(k), [(s["psi_critical"], "critical"), (s["psi_warning"], "warning")]), "stability", f"{k} is high", f"{k} {result.get(k)}", "look at the features that moved", culprits)
        base = result.get("test_ks", result.get("trn_ks"))
        if result.get("oot_ks") is not None and base:
            decay = (base - result["oot_ks"]) / base
            add(above(decay, [(s["decay_critical"], "critical"), (s["decay_warning"], "warning")]), "stability", "KS decays out of time", f"decay {decay:.4f}", "retrain on newer data", culprits)
        if result.get("test_auc") is not None and (result.get("trn_auc") or 0) > 0.5:
            loss = (result["trn_auc"] - result["test_auc"]) / (result["trn_auc"] - 0.5)
            add(above(loss, [(s["auc_loss"], "warning")]), "stability", "AUC falls from train to test", f"loss {loss:.4f}", "use fewer or coarser features")
        for c, v in sorted((coef or {}).items()):
            add("warning" if v <= 0 else None, "coefficients", f"{c} has the wrong sign", f"coefficient {v:.4f}", "drop it or its rivals", (c,))
    v = at["variables"]
    for c, t in tables.items():
        n = sum(b.bad + b.good for b in t.bins)
        share = (missing or {}).get(c, sum(b.bad + b.good for b in t.bins if b.kind == "missing") / n if n else 0.0)
        add(above(share, [(v["missing_critical"], "critical"), (v["missing_warning"], "warning")]), "variables", f"{c} is often missing", f"share {share:.4f}", "find the cause", (c,))
        add(above(t.iv_total, [(v["iv_high"], "warning")]), "variables", f"{c} has a very high IV", f"IV {t.iv_total:.4f}", "check for leakage", (c,))
        add("info" if 0 < t.iv_total < v["iv_low"] else None, "variables", f"{c} has a low IV", f"IV {t.iv_total:.4f}", "drop it", (c,))
        add("info" if t.trend_match is False else None, "variables", f"{c} has another trend than wanted", f"code {t.monotonic}", "set cuts by hand", (c,))
    if not result and tables:
        strong = sum(1 for t in tables.values() if t.iv_total >= v["iv_low"])
        add("critical" if strong < v["min_strong"] else None, "variables", "few strong features", f"{strong} of {len(tables)}", "get more data")
    if bad_rate is not None and bad_rate < at["target"]["min_bad_rate"]:
        add("warning", "target", "low bad rate", f"{bad_rate:.4f}", "collect more bad rows")
    return Report(out)
