"""The whole way from a table to a scorecard as a chain of steps; each step returns the chain and keeps its result on it.

A step that comes too early raises RuntimeError. When no feature is left, the chain halts: later steps warn and do nothing.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_numeric, without_nan
from ..operators import binning, diagnosis, metrics, profile, rules, scorecard, screening, woe
from ..operators.quality_report import quality


@dataclass(frozen=True)
class Spec:
    """Options of the steps, by section; explicit arguments of a step win over them."""

    prefilter: dict = field(default_factory=dict)
    binning: dict = field(default_factory=dict)
    refine: dict = field(default_factory=dict)
    select: dict = field(default_factory=dict)
    model: dict = field(default_factory=dict)
    rules: dict = field(default_factory=dict)

    def merge(self, **sections: dict) -> Spec:
        return replace(self, **{k: getattr(self, k) | v for k, v in sections.items()})


class Chain:
    def __init__(self, spec: Spec | None = None) -> None:
        self.spec = spec or Spec()
        self.train: DataFrame | None = None
        self.test = self.oot = self.target = self.id_col = None
        self.features: list[str] = []
        self.detect_ = self.quality_ = self.prefilter_ = self.refine_ = self.tables = self.rules_ = None
        self.selector_ = self.model_ = self.card = self.evaluation_ = self.diagnosis_ = None
        self.encoded: dict[str, DataFrame] = {}
        self.outcomes: list[screening.ScreenOutcome] = []
        self.halt_message: str | None = None

    @property
    def halted(self) -> bool:
        return self.halt_message is not None

    @property
    def support(self) -> list[str]:
        return self.selector_.support if self.selector_ else self.features

    def apply(self, spec: Spec) -> Chain:
        self.spec = spec
        return self

    def _needs(self, **parts: object) -> bool:
        for name, value in parts.items():
            if value is None:
                raise RuntimeError(f"{name} must come first")
        if self.halted:
            warnings.warn(f"nothing done: {self.halt_message}", stacklevel=3)
        return not self.halted

    def _screened(self, stage: str, found: screening.Screen, kept: list[str]) -> None:
        self.features = kept
        outcome = screening.assess_screen(kept, stage=stage, n_candidates=found.n_candidates)
        self.outcomes.append(outcome)
        if not outcome.ok:
            self.halt_message = outcome.message

    def read(self, train: DataFrame, *, target: str, test: DataFrame | None = None, oot: DataFrame | None = None, id_col: str | None = None) -> Chain:
        """Registers the samples; they must have the same columns. The id and the target are no features."""
        for name, other in (("test", test), ("oot", oot)):
            if other is not None and set(other.columns) != set(train.columns):
                raise ValueError(f"{name} has other columns: {sorted(set(other.columns) ^ set(train.columns))}")
        if target not in train.columns:
            raise ValueError(f"no column {target}")
        profile.require_unique(train.columns)
        self.train, self.target, self.id_col = without_nan(train), target, id_col
        self.test, self.oot = (without_nan(d) if d is not None else None for d in (test, oot))
        self.features = [c for c in train.columns if c not in (target, id_col) and dict(train.dtypes)[c] not in ("timestamp", "timestamp_ntz", "date")]
        return self

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.features if is_numeric(self.train, c)]

    def detect(self, **options: object) -> Chain:
        if self._needs(read=self.train):
            self.detect_ = profile.detect(self.train, self.target, **options)
        return self

    def quality(self, **options: object) -> Chain:
        if self._needs(read=self.train):
            self.quality_ = quality(self.train, self.target, self.features, self.test, **options)
        return self

    def prefilter(self, **options: object) -> Chain:
        """Screens the numeric features on raw values; categories always pass."""
        if self._needs(read=self.train):
            self.prefilter_ = screening.screen(self.train, self.target, self.numeric, test=self.test, **{**self.spec.prefilter, **options})
            numbers = set(self.numeric)
            self._screened("prefilter", self.prefilter_, [c for c in self.features if c not in numbers or c in self.prefilter_.support])
        return self

    def bin(self, config: dict[str, dict] | None = None, **options: object) -> Chain:
        if self._needs(read=self.train):
            self.tables = binning.fit(self.train, self.target, self.features, binning.Settings(**{**self.spec.binning, **options}), config)
            self.features = [c for c in self.features if c in self.tables]
        return self

    def refine(self, **options: object) -> Chain:
        """Screens the numeric features again, by the IV of their bins."""
        if self._needs(bin=self.tables):
            if not self.numeric:
                warnings.warn("no numeric feature to refine", stacklevel=2)
                return self
            numbers = set(self.numeric)
            self.refine_ = screening.screen(self.train, self.target, self.numeric, test=self.test, tables={c: self.tables[c] for c in numbers}, **{**self.spec.refine, **options})
            self._screened("refine", self.refine_, [c for c in self.features if c not in numbers or c in self.refine_.support])
        return self

    filter = refine

    def mine_rules(self, remove: bool = True, **options: object) -> Chain:
        """Mines rules of the numeric features; features in rules leave the selection."""
        if self._needs(bin=self.tables):
            self.rules_ = rules.mine(self.train, self.target, self.numeric, rules.RuleSettings(**{**self.spec.rules, **options}), self.tables)
            if remove:
                used = set(rules.used_features(self.rules_))
                self.features = [c for c in self.features if c not in used]
        return self

    def transform(self, unseen_strategy: str = "worst") -> Chain:
        if self._needs(bin=self.tables):
            own = {c: self.tables[c] for c in self.features}
            for name, df in (("train", self.train), ("test", self.test), ("oot", self.oot)):
                if df is not None:
                    self.encoded[name] = woe.woe_transform(df, own, unseen_strategy).select(*self.features, self.target)
        return self

    def select(self, force_in: list[str] | None = None, **options: object) -> Chain:
        if self._needs(transform=self.encoded or None):
            settings = scorecard.StepwiseSettings(**{**self.spec.select, **options})
            self.selector_ = scorecard.stepwise(self.encoded["train"], self.target, self.features, self.encoded.get("test"), settings, force_in)
            if not self.selector_.support:
                self.halt_message = "no feature selected"
        return self

    def fit(self, **options: object) -> Chain:
        if self._needs(transform=self.encoded or None):
            self.model_ = scorecard.fit_model(self.encoded["train"], self.target, self.support)
            self.card = scorecard.ScoreCard(self.model_, self.tables, **{**self.spec.model, **options})
        return self

    def scorecard(self) -> Chain:
        if self._needs(fit=self.card):
            self.points_ = self.card.points(self.train.sparkSession)
        return self

    def probabilities(self) -> DataFrame:
        """sample, p, target of all samples."""
        out = None
        for name, df in self.encoded.items():
            p = self.card.probability({c: F.col(c) for c in self.support})
            one = df.select(F.lit(name).alias("sample"), F.round(p, 10).alias("p"), F.col(self.target).alias("y"))
            out = one if out is None else out.union(one)
        return out

    def evaluate(self, n_bins: int = 10, threshold: float = 0.5) -> Chain:
        """evaluation_: KS, AUC and accuracy of each sample, losses and PSI; score_table of the test (or else training) sample."""
        if self._needs(fit=self.card):
            self.evaluation_ = {"model_vars": self.support, "n_vars": len(self.support)} | metrics.evaluate_rows(self.probabilities(), n_bins, threshold)
        return self

    def evaluate_frame(self) -> DataFrame:
        """The figures of evaluate() as rows (metric, value)."""
        if self.evaluation_ is None:
            self.evaluate()
        rows = [(k, float(v)) for k, v in sorted((self.evaluation_ or {}).items()) if isinstance(v, (int, float))]
        return self.train.sparkSession.createDataFrame(rows, "metric string, value double")

    def diagnose(self, own_limits: dict | None = None) -> Chain:
        """Before a model from the bins alone, later from the evaluation too."""
        if self._needs(bin=self.tables):
            bad_rate = self.train.agg(F.avg(F.col(self.target).cast("double"))).first()[0]
            coef = self.model_.coef if self.model_ else None
            self.diagnosis_ = diagnosis.diagnose(self.evaluation_, tables=self.tables, coef=coef, bad_rate=bad_rate, own_limits=own_limits)
        return self
