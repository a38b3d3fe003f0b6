"""Logistic regression on WOE columns, scaling to points, prediction; stepwise selection on the compressed sample.

WOE columns have few values, so the sample is compressed to one row per combination with its counts: one shuffle, after which
every fit is on the driver. Beyond COMBINATIONS rows the fit is Spark's own, on the compressed rows; stepwise selection then
raises an error, or with the setting `distributed` leaves the rows in Spark and takes some jobs for each trial.
"""

from __future__ import annotations

import math
import random
import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import vifs
from ..functions.logit import Logit, fit_logit, information, ks_auc, newton
from .binning import BinTable
from .woe import woe_column

COMBINATIONS = 200_000


@dataclass
class Sample:
    """Distinct combinations of WOE values with the bad rows and all rows in each."""

    names: list[str]
    x: np.ndarray
    bad: np.ndarray
    n: np.ndarray

    def matrix(self, names: list[str]) -> np.ndarray:
        return self.x[:, [self.names.index(c) for c in names]]

    def covariance(self) -> np.ndarray:
        weight = self.n / self.n.sum()
        centred = self.x - weight @ self.x
        return (centred * weight[:, None]).T @ centred

    def fit(self, names: list[str]) -> Logit | None:
        return fit_logit(names, self.matrix(names), self.bad, self.n)

    def ks_auc(self, model: Logit) -> tuple[float, float]:
        return ks_auc(model.margin(self.matrix(model.names)), self.bad, self.n)


class SpreadSample:
    """A sample of any number of combinations, which stay in Spark. What a trial needs is compressed to its own columns;
    if these are too many combinations as well, sums by partition and by range of margins go to the driver."""

    def __init__(self, df: DataFrame, target: str, columns: list[str]) -> None:
        self.names = columns
        self.rows = combinations(df, target, columns).withColumns({c: F.col(c).cast("double") for c in ("_bad", "_n", *columns)}).persist()

    def compressed(self, names: list[str]) -> Sample | DataFrame:
        rows = self.rows.groupBy(*names).agg(F.sum("_bad").alias("_bad"), F.sum("_n").alias("_n"))
        found = rows.limit(COMBINATIONS + 1).toArrow()
        if found.num_rows > COMBINATIONS:
            return self.rows.select(*names, "_bad", "_n")
        x = np.column_stack([found[c].to_numpy() for c in names])
        order = np.lexsort(x.T[::-1])
        return Sample(names, x[order], found["_bad"].to_numpy()[order], found["_n"].to_numpy()[order])

    def covariance(self) -> np.ndarray:
        total, k = F.sum("_n"), len(self.names)
        mean = list(self.rows.agg(*(F.sum(F.col(c) * F.col("_n")) / total for c in self.names)).first())
        centred = [F.col(c) - F.lit(m) for c, m in zip(self.names, mean, strict=True)]
        found = iter(self.rows.agg(*(F.sum(centred[i] * centred[j] * F.col("_n")) / total for i in range(k) for j in range(i, k))).first())
        out = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                out[i, j] = out[j, i] = next(found)
        return out

    def fit(self, names: list[str]) -> Logit | None:
        rows = self.compressed(names)
        if isinstance(rows, Sample):
            return rows.fit(names)

        def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    info, slope = information(frame[names].to_numpy(), frame["_bad"].to_numpy(), frame["_n"].to_numpy(), beta)
                    yield pd.DataFrame({"v": [[*info.ravel(), *slope]]})

            k = len(beta)
            found = rows.mapInPandas(part, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
            v = np.array([r.v for r in found])
            return v[: k * k].reshape(k, k), v[k * k :]

        return newton(names, sums)

    def ks_auc(self, model: Logit) -> tuple[float, float]:
        rows = self.compressed(model.names)
        if isinstance(rows, Sample):
            return rows.ks_auc(model)
        margin = F.lit(model.intercept)
        for c, coef in model.coef.items():
            margin = margin + F.lit(coef) * F.col(c)
        rows = rows.groupBy(margin.alias("z")).agg(F.sum("_bad").alias("b"), F.sum("_n").alias("t"))
        rows = rows.repartitionByRange("z").sortWithinPartitions("z").select("z", "b", "t", F.spark_partition_id().alias("part")).persist()
        try:
            ranges = rows.groupBy("part").agg(F.min("z").alias("z"), F.sum("b").alias("b"), F.sum("t").alias("t")).orderBy("z").collect()
            bad, good = sum(r.b for r in ranges), sum(r.t - r.b for r in ranges)
            if not bad or not good:
                return 0.0, 0.5
            before, b, g = {}, 0.0, 0.0
            for r in ranges:
                before[r.part] = b, g
                b, g = b + r.b, g + r.t - r.b

            def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                so_far = {}
                for frame in frames:
                    for p, own in frame.groupby("part", sort=False):
                        b0, g0 = so_far.get(p, before[p])
                        b, g = own["b"].to_numpy(), (own["t"] - own["b"]).to_numpy()
                        cb, cg = b0 + np.cumsum(b), g0 + np.cumsum(g)
                        so_far[p] = cb[-1], cg[-1]
                        yield pd.DataFrame({"ks": [np.abs(cb / bad - cg / good).max()], "area": [(b * (cg - g / 2)).sum()]})

            ks, area = rows.mapInPandas(part, "ks double, area double").agg(F.max("ks"), F.sum("area")).first()
            return ks, area / (bad * good)
        finally:
            rows.unpersist()


def combinations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.sum(target).alias("_bad"), F.count(target).alias("_n"))


def compress(df: DataFrame, target: str, columns: list[str]) -> Sample | None:
    """None if there are more combinations than the driver should hold."""
    rows = combinations(df, target, columns).limit(COMBINATIONS + 1).toArrow()
    if rows.num_rows > COMBINATIONS:
        return None
    x = np.column_stack([rows[c].to_numpy(zero_copy_only=False) for c in columns]) if columns else np.zeros((rows.num_rows, 0))
    order = np.lexsort(x.T[::-1]) if columns else np.arange(rows.num_rows)
    return Sample(columns, x[order].astype(float), rows["_bad"].to_numpy()[order].astype(float), rows["_n"].to_numpy()[order].astype(float))


def fit_model(df: DataFrame, target: str, columns: list[str]) -> Logit:
    """An unpenalised logit with intercept; bad = 1."""
    if not columns:
        raise ValueError("no features to fit")
    if (sample := compress(df, target, columns)) is not None:
        model = fit_logit(columns, sample.x, sample.bad, sample.n, rounds=200)
        if model is None:
            raise ValueError("the features are collinear")
        return model
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = combinations(df, target, columns).withColumn("_rate", F.col("_bad") / F.col("_n"))
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows)
    found = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="_rate", weightCol="_n", maxIter=200).fit(rows)
    errors = list(found.summary.coefficientStandardErrors)  # the intercept is last there
    return Logit(columns, np.array([found.intercept, *found.coefficients]), np.array([errors[-1], *errors[:-1]]), True)


@dataclass
class ScoreCard:
    """score = base_score + factor (ln odds + intercept) - sum of factor * coefficient * WOE, factor = pdo / ln 2; higher is safer."""

    model: Logit
    tables: dict[str, BinTable]
    odds: float = 50
    pdo: float = 10
    base_score: float = 600
    strategy: str = "worst"

    @property
    def factor(self) -> float:
        return self.pdo / math.log(2)

    @property
    def offset(self) -> float:
        return self.base_score + self.factor * (math.log(self.odds) + self.model.intercept)

    def points(self, spark: SparkSession) -> DataFrame:
        """A row for each feature and bin."""
        rows = []
        for c, coef in sorted(self.model.coef.items()):
            for i, b in enumerate(self.tables[c].bins):
                n = b.bad + b.good
                extra = b.kind == "missing" or (b.lo is not None and b.lo == b.hi)
                rows.append((c, b.label, i, n, round(b.bad / n, 6) if n else 0.0, b.woe, coef, round(-self.factor * coef * b.woe, 2), extra))
        return spark.createDataFrame(rows, "variable string, bin_label string, bin_no int, count long, bad_rate double, woe double, coef double, points double, is_extra boolean")

    def woe(self, c: str) -> Column:
        return woe_column(self.tables[c], F.col(c), self.strategy)

    def score(self, woes: dict[str, Column] | None = None) -> Column:
        """The score of a row of raw values, or of given WOE columns. An expression: no shuffle, no Python."""
        out = F.lit(self.offset)
        for c, coef in sorted(self.model.coef.items()):
            out = out - F.lit(self.factor * coef) * (woes[c] if woes else self.woe(c))
        return out

    def probability(self, woes: dict[str, Column] | None = None) -> Column:
        """Of being bad."""
        z = F.lit(self.model.intercept)
        for c, coef in sorted(self.model.coef.items()):
            z = z + F.lit(coef) * (woes[c] if woes else self.woe(c))
        return 1 / (1 + F.exp(-z))


@dataclass
class StepwiseSettings:
    pvalue_threshold: float = 0.05
    coef_sign: str = "positive"
    vif_threshold: float = 10
    corr_threshold: float = 0.8
    feature_belong: dict[str, str] | None = None
    belong_max_pct: float | None = None
    perturbation: bool = True
    perturbation_pct: float = 0.1
    perturbation_add: int = 2
    max_iter_round: int = 100
    max_iter_time: float = 600
    same_round_exit: int = 4
    r: float = 0.8
    objective: str | Callable[[dict], float] = "ks_reduce"
    goal_threshold: float = 0.01
    n_min: int = 5
    n_max: int = 15
    force_fill: bool = True
    random_state: int | None = None
    distributed: bool = False


@dataclass
class Stepwise:
    support: list[str]
    record: list[tuple]
    performance: dict[str, float]
    model: Logit | None = None
    passed: bool = False
    notes: list[str] = field(default_factory=list)

    RECORD = "round int, vars string, n_vars int, score double, passed boolean, trn_ks double, test_ks double, ks_reduce double, trn_auc double, test_auc double, auc_reduce double"

    def record_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.record, self.RECORD)


class Selector:
    """Forward, backward and perturbed selection. All of it works on the compressed samples; nothing here touches rows."""

    def __init__(self, train: Sample | SpreadSample, test: Sample | SpreadSample | None, settings: StepwiseSettings, force_in: list[str] | None = None) -> None:
        self.train, self.test, self.s = train, test, settings
        self.force_in = list(force_in or [])
        self.fits: dict[tuple[str, ...], Logit | None] = {}
        self.random = random.Random(settings.random_state if settings.random_state is not None else 0)
        cov = train.covariance()
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
        self.corr = cov / np.outer(scale, scale)
        unknown = set(settings.feature_belong or {}) - set(train.names)
        if unknown:
            raise KeyError(f"unknown features in feature_belong: {sorted(unknown)}")

    def model(self, names: list[str]) -> Logit | None:
        key = tuple(sorted(names))
        if key not in self.fits:
            self.fits[key] = self.train.fit(list(key)) if key else None
        return self.fits[key]

    def performance(self, names: list[str]) -> dict[str, float]:
        model, out = self.model(names), {}
        for part, sample in (("trn", self.train), ("test", self.test)):
            if sample is not None:
                ks, auc = sample.ks_auc(model) if model else (0.0, 0.5)
                out |= {f"{part}_ks": ks, f"{part}_auc": auc}
        return out

    def goal(self, perf: dict[str, float]) -> float:
        """test + (1 - r) train - r (train - test), or train alone."""
        if callable(self.s.objective):
            return self.s.objective(perf)
        kind = self.s.objective.split("_")[0]
        train, test = perf[f"trn_{kind}"], perf.get(f"test_{kind}")
        return train if test is None else test + (1 - self.s.r) * train - self.s.r * (train - test)

    def train_goal(self, names: list[str]) -> float:
        perf = {k: v for k, v in self.performance(names).items() if k.startswith("trn")}
        return self.goal(perf) if names else 0.0

    def vifs(self, names: list[str]) -> list[float]:
        at = [self.train.names.index(c) for c in names]
        return vifs(self.corr[np.ix_(at, at)])

    def allowed(self, names: list[str]) -> int | None:
        if not self.s.feature_belong or self.s.belong_max_pct is None:
            return None
        return int(self.s.n_max * self.s.belong_max_pct) if self.s.belong_max_pct < 1 else int(self.s.belong_max_pct)

    def acceptable(self, names: list[str]) -> bool:
        """p-values, signs, VIF, correlations and the share of each source."""
        model = self.model(names)
        if model is None:
            return False
        if any(not p <= self.s.pvalue_threshold for p in model.p_values.values()):
            return False
        sign = {"positive": 1, "negative": -1}.get(self.s.coef_sign, 0)
        if sign and any(c * sign <= 0 for c in model.coef.values()):
            return False
        if len(names) > 1:
            at = [self.train.names.index(c) for c in names]
            own = np.abs(self.corr[np.ix_(at, at)]) - np.eye(len(at))
            if own.max() > self.s.corr_threshold or max(self.vifs(names)) > self.s.vif_threshold:
                return False
        most = self.allowed(names)
        if most is not None:
            sources = [self.s.feature_belong.get(c) for c in names]
            if any(s is not None and sources.count(s) > most for s in sources):
                return False
        return True

    def forward(self, names: list[str], pool: list[str]) -> list[str]:
        score = self.train_goal(names)
        while len(names) < self.s.n_max:
            tried = [(self.train_goal([*names, c]), -i, c) for i, c in enumerate(pool) if c not in names and self.acceptable([*names, c])]
            if not tried or max(tried)[0] - score < self.s.goal_threshold:
                return names
            score, _, chosen = max(tried)
            names = [*names, chosen]
        return names

    def backward(self, names: list[str]) -> list[str]:
        score = self.train_goal(names)
        while len(names) > 1:
            tried = [(self.train_goal([x for x in names if x != c]), -i, c) for i, c in enumerate(names) if c not in self.force_in]
            if not tried or max(tried)[0] - score < self.s.goal_threshold:
                return names
            score, _, gone = max(tried)
            names = [x for x in names if x != gone]
        return names

    def perturb(self, names: list[str], pool: list[str]) -> list[str]:
        """Drops some at random and adds some of the other candidates."""
        free = [c for c in names if c not in self.force_in]
        gone = self.random.sample(free, min(len(free), max(1, int(len(names) * self.s.perturbation_pct))))
        others = [c for c in pool if c not in names]
        return [c for c in names if c not in gone] + self.random.sample(others, min(len(others), self.s.perturbation_add))

    def trimmed(self, names: list[str]) -> list[str]:
        most, seen, out = self.allowed(names), {}, []
        for c in names:
            source = (self.s.feature_belong or {}).get(c)
            seen[source] = seen.get(source, 0) + 1
            if most is None or source is None or seen[source] <= most:
                out.append(c)
        return out

    def run(self, candidates: list[str] | None = None) -> Stepwise:
        pool = list(candidates or self.train.names)
        if self.test is None and isinstance(self.s.objective, str) and self.s.objective.endswith("_reduce"):
            warnings.warn("without a test sample the objective is of the training sample alone", stacklevel=2)
        names, began = list(self.force_in), time.monotonic()
        best, record, same = (-math.inf, [], {}), [], 0
        for turn in range(1, self.s.max_iter_round + 1):
            before = sorted(names)
            names = self.backward(self.forward(names, pool))
            perf = self.performance(names)
            score = self.goal(perf)
            passed = self.acceptable(names) and self.s.n_min <= len(names) <= self.s.n_max
            cut = lambda k: perf[f"trn_{k}"] - perf[f"test_{k}"] if f"test_{k}" in perf else None  # noqa: B023, E731
            six = [None if v is None else round(v, 6) for v in (perf["trn_ks"], perf.get("test_ks"), cut("ks"), perf["trn_auc"], perf.get("test_auc"), cut("auc"))]
            record.append((turn, ",".join(names), len(names), round(score, 6), passed, *six))
            if passed and score > best[0]:
                best = (score, list(names), perf)
            same = same + 1 if sorted(names) == before else 0
            if (passed and same >= self.s.same_round_exit) or time.monotonic() - began > self.s.max_iter_time:
                break
            if not passed and same >= 2:
                if not self.s.perturbation:
                    break
                names = self.perturb(names, pool)
            names = self.trimmed(names)
        _, support, perf = best
        support, notes = support or list(self.force_in), []
        if self.s.force_fill and len(support) < self.s.n_min:
            for c in pool:
                if len(support) < self.s.n_min and c not in support and self.acceptable([*support, c]):
                    support = [*support, c]
            notes.append("filled up")
        if not support:
            support = list(names)
            notes.append("fell back on the last round")
        return Stepwise(support, record, perf or self.performance(support), self.model(support), best[0] > -math.inf, notes)


def stepwise(train: DataFrame, target: str, columns: list[str], test: DataFrame | None = None, settings: StepwiseSettings | None = None, force_in: list[str] | None = None, candidates: list[str] | None = None) -> Stepwise:
    """Stepwise selection among WOE columns. Reads each sample once."""
    settings = settings or StepwiseSettings()
    samples = [compress(d, target, columns) if d is not None else None for d in (train, test)]
    for i, d in enumerate((train, test)):
        if d is not None and samples[i] is None:
            if not settings.distributed:
                raise ValueError(f"more than {COMBINATIONS} combinations of WOE values; set `distributed`, screen the features or bin them coarser")
            samples[i] = SpreadSample(d, target, columns)
    try:
        return Selector(*samples, settings, force_in).run(candidates)
    finally:
        for sample in samples:
            if isinstance(sample, SpreadSample):
                sample.rows.unpersist()
