"""Monitoring of a model in use: a baseline, batches of scores against it, alerts, history; baselines as JSON."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binning import Bin, BinTable, index_column
from .metrics import ks_auc

EPS = 1e-6
# The default alert rules.
DEFAULT_RULES = (
    {"metric": "psi_score", "op": ">", "value": 0.10, "level": "warn", "message": "score PSI above 0.10"},
    {"metric": "psi_score", "op": ">", "value": 0.25, "level": "critical", "message": "score PSI above 0.25"},
    {"metric": "psi_feature", "op": ">", "value": 0.25, "level": "warn", "message": "feature PSI above 0.25"},
    {"metric": "ks_decay", "op": ">", "value": 0.15, "level": "warn", "message": "KS decay above 15 %"},
    {"metric": "ks_decay", "op": ">", "value": 0.30, "level": "critical", "message": "KS decay above 30 %"},
)
HISTORY = "period string, timestamp string, n long, bad_rate double, ks double, auc double, psi_score double, psi_features_n int, n_alerts int, status string"
COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: abs(a - b) <= 1e-9}


def compare(a: float, op: str, b: float) -> bool:
    return COMPARE.get(op, lambda a, b: False)(a, b)


def psi(expected: dict, actual: dict) -> float | None:
    """Of two histograms by bin; None if one is empty."""
    import math

    e_all, a_all = sum(expected.values()), sum(actual.values())
    if not e_all or not a_all:
        return None
    out = 0.0
    for k in sorted(set(expected) | set(actual), key=str):
        e, a = (min(1.0, max(EPS, d.get(k, 0) / n)) for d, n in ((expected, e_all), (actual, a_all)))
        out += (a - e) * math.log(a / e)
    return round(out, 6)


@dataclass
class Snapshot:
    period: str
    n: int
    bad_rate: float | None
    ks: float | None
    auc: float | None
    psi_score: float | None
    ks_decay: float | None = None
    auc_decay: float | None = None
    psi_features: dict[str, float] = field(default_factory=dict)
    alerts: list[tuple[str, str]] = field(default_factory=list)
    """(level, message)"""
    psi_trend: float | None = None
    timestamp: str | None = None
    """When it was taken (ISO 8601, UTC)."""

    @property
    def status(self) -> str:
        levels = {level for level, _ in self.alerts}
        return "critical" if "critical" in levels else "warn" if "warn" in levels else "ok"

    @property
    def recommendation(self) -> str:
        return {"critical": "review and redevelop the model", "warn": "watch the model and find the cause", "ok": "no action"}[self.status]


@dataclass
class Monitor:
    lo: float
    hi: float
    bins: int
    scores: dict[int, int]
    ks: float
    auc: float
    features: dict[str, dict[str, int]] = field(default_factory=dict)
    tables: dict[str, BinTable] = field(default_factory=dict)
    rules: tuple[dict, ...] = DEFAULT_RULES
    snapshots: list[Snapshot] = field(default_factory=list)

    def score_bin(self, score: Column) -> Column:
        """Equal-width bins of the baseline's range, the last closed; NULL outside."""
        width = (self.hi - self.lo) / self.bins
        at = F.least(F.floor((score - self.lo) / width), F.lit(self.bins - 1)) if width > 0 else F.lit(0)
        return F.when(score.between(self.lo, self.hi), at.cast("int"))

    def _feature_counts(self, df: DataFrame) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {}
        for c in self.tables:
            if c not in df.columns:
                warnings.warn(f"no column {c} to follow", stacklevel=3)
        known = {c: t for c, t in self.tables.items() if c in df.columns}
        if known:
            pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("v"), index_column(t, F.col(c)).alias("b")) for c, t in known.items())))
            for v, b, n in df.select(pairs.alias("p")).groupBy("p.v", "p.b").count().where("b IS NOT NULL").collect():
                out.setdefault(v, {})[str(b)] = n
        return out

    def track(self, df: DataFrame, period: str, score: str, target: str | None = None) -> Snapshot:
        """Adds what a batch of scores (higher is safer) shows against the baseline. Two or three aggregates; only counts are collected."""
        rows = df.groupBy(self.score_bin(F.col(score)).alias("b")).count().collect()
        n, held = sum(r[1] for r in rows), {r[0]: r[1] for r in rows if r[0] is not None}
        found = ks_auc(df, -F.col(score), target, []).first() if target else None
        decay = lambda now, base, floor: round((base - now) / base, 6) if found and base > floor else None
        snap = Snapshot(
            period, n, found and found.bad_rate, found and found.ks, found and found.auc, psi(self.scores, held),
            decay(found.ks, self.ks, 0) if found else None, decay(found.auc, self.auc, 0.5) if found else None,
        )
        current = self._feature_counts(df)
        snap.psi_features = {c: v for c in current if (v := psi(self.features.get(c, {}), current[c])) is not None}
        if self.snapshots and snap.psi_score is not None and self.snapshots[-1].psi_score is not None:
            snap.psi_trend = round(snap.psi_score - self.snapshots[-1].psi_score, 6)
        snap.alerts = alerts(snap, self.rules)
        snap.timestamp = datetime.now(UTC).isoformat(timespec="seconds")
        self.add_snapshot(snap)
        return snap

    def add_snapshot(self, snap: Snapshot) -> None:
        """Appends a snapshot as it is, for example one of an earlier time."""
        self.snapshots.append(snap)

    def latest_alerts(self) -> list[tuple[str, str]]:
        """What the last snapshot's alerts are."""
        return self.snapshots[-1].alerts if self.snapshots else []

    def history(self, spark: SparkSession) -> DataFrame:
        rows = [(s.period, s.timestamp, s.n, s.bad_rate, s.ks, s.auc, s.psi_score, len(s.psi_features), len(s.alerts), s.status) for s in self.snapshots]
        return spark.createDataFrame(rows, HISTORY)

    def save(self, path: str) -> None:
        with open(path, "w") as file:
            json.dump(asdict(self), file)

    @classmethod
    def load(cls, path: str) -> Monitor:
        with open(path) as file:
            held = json.load(file)
        tables = {c: BinTable(**t | {"bins": [Bin(**b) for b in t["bins"]]}) for c, t in held.pop("tables").items()}
        snapshots = [Snapshot(**s | {"alerts": [tuple(a) for a in s["alerts"]]}) for s in held.pop("snapshots")]
        scores = {int(k): v for k, v in held.pop("scores").items()}
        return cls(**held | {"tables": tables, "snapshots": snapshots, "scores": scores, "rules": tuple(held["rules"])})


def alerts(snap: Snapshot, rules: tuple[dict, ...] = DEFAULT_RULES) -> list[tuple[str, str]]:
    """All rules that hold; psi_feature is tried for each feature."""
    out = []
    for r in rules:
        if r["metric"] == "psi_feature":
            values = [(v, f"{c}: ") for c, v in sorted(snap.psi_features.items())]
        else:
            values = [(getattr(snap, r["metric"], None), "")]
        out += [(r["level"], f"[{r['level']}] {name}{r['message']}") for v, name in values if v is not None and compare(v, r["op"], r["value"])]
    return out


def thresholds(psi_warn: float = 0.10, psi_critical: float = 0.25, ks_decay_warn: float = 0.15, ks_decay_critical: float = 0.30) -> tuple[dict, ...]:
    """The default rules with limits of one's own."""
    values = {("psi_score", "warn"): psi_warn, ("psi_score", "critical"): psi_critical, ("ks_decay", "warn"): ks_decay_warn, ("ks_decay", "critical"): ks_decay_critical}
    return tuple(r | {"value": values.get((r["metric"], r["level"]), r["value"])} for r in DEFAULT_RULES)


def baseline(df: DataFrame, score: str, target: str, tables: dict[str, BinTable] | None = None, bins: int = 20, rules: tuple[dict, ...] = DEFAULT_RULES) -> Monitor:
    """A monitor from development scores (higher is safer), their outcomes and the bins of the features to follow."""
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    found = ks_auc(df, -F.col(score), target, []).first()
    out = Monitor(lo, hi, bins, {}, found.ks, found.auc, {}, dict(tables or {}), rules)
    out.scores = {r[0]: r[1] for r in df.groupBy(out.score_bin(F.col(score)).alias("b")).count().collect() if r[0] is not None}
    out.features = out._feature_counts(df)
    return out


def from_chain(chain, key_features: list[str] | None = None, bins: int = 20, rules: tuple[dict, ...] = DEFAULT_RULES) -> Monitor:
    """A monitor from the training sample of a chain whose card is made; follows key_features, or else the features of the model."""
    if chain.card is None or not chain.tables or not chain.encoded:
        raise RuntimeError("bin, transform and fit must come first")
    followed = key_features or chain.support
    if not followed:
        raise RuntimeError("no feature to follow")
    scored = chain.train.withColumn("_score", chain.card.score()).select("_score", chain.target, *followed)
    return baseline(scored, "_score", chain.target, {c: chain.tables[c] for c in followed if c in chain.tables}, bins, rules)
