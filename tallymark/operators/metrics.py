"""Evaluation of scores: KS, AUC, accuracy, PSI, score tables, by split or period.

Rows are summed by distinct score first. Running sums over scores are windows within a key (split, period).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import bin_index
from .drift import psi_of
from .profile import quantile_edges


def by_score(df: DataFrame, score: Column, target: str, keys: list[str]) -> DataFrame:
    """keys, score, bad, good, and running counts of both up to each score."""
    cells = df.where(score.isNotNull() & F.col(target).isNotNull()).groupBy(*keys, score.alias("score"))
    cells = cells.agg(F.sum(target).alias("bad"), F.sum(1 - F.col(target)).alias("good"))
    line = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumns({"cum_bad": F.sum("bad").over(line), "cum_good": F.sum("good").over(line)})


def ks_auc(df: DataFrame, score: Column, target: str, keys: list[str]) -> DataFrame:
    """keys, n, bad_rate, ks, auc (6 digits). score: higher is worse. Ties count one half; KS 0 and AUC 0.5 with one class."""
    cells, whole = by_score(df, score, target, keys), Window.partitionBy(*keys)
    cells = cells.withColumns({"b": F.sum("bad").over(whole), "g": F.sum("good").over(whole)})
    both = (F.col("b") > 0) & (F.col("g") > 0)
    nb, ng = F.nullif("b", F.lit(0)), F.nullif("g", F.lit(0))
    apart = F.max(F.abs(F.col("cum_bad") / nb - F.col("cum_good") / ng))
    area = F.sum(F.col("bad") * (F.col("cum_good") - F.col("good") / 2) / (nb * ng))
    return cells.groupBy(*keys).agg(
        F.sum(F.col("bad") + F.col("good")).alias("n"), F.round(F.sum("bad") / F.sum(F.col("bad") + F.col("good")), 6).alias("bad_rate"),
        F.round(F.coalesce(F.max(F.when(both, F.lit(1.0))) * apart, F.lit(0.0)), 6).alias("ks"), F.round(F.coalesce(area, F.lit(0.5)), 6).alias("auc"),
    )


def signed_ks(df: DataFrame, score: Column, target: str, keys: list[str]) -> DataFrame:
    """keys, ks: the largest lead of the bad over the good share, by ascending score; NULL with one class."""
    cells, whole = by_score(df, score, target, keys), Window.partitionBy(*keys)
    cells = cells.withColumns({"b": F.nullif(F.sum("bad").over(whole), F.lit(0)), "g": F.nullif(F.sum("good").over(whole), F.lit(0))})
    return cells.groupBy(*keys).agg(F.round(F.max(F.col("cum_bad") / F.col("b") - F.col("cum_good") / F.col("g")), 6).alias("ks"))


def accuracy(df: DataFrame, probability: Column, target: str, keys: list[str], threshold: float = 0.5) -> DataFrame:
    right = ((probability >= threshold).cast("int") == F.col(target)).cast("double")
    return df.groupBy(*keys).agg(F.round(F.avg(right), 6).alias("acc"))


def score_edges(train: DataFrame, score: str, n_bins: int = 10) -> list[float]:
    """Inner quantile cuts of the training scores."""
    return quantile_edges(train, [score], n_bins)[score][1:-1]


def score_table(df: DataFrame, score: str, target: str, cuts: list[float]) -> DataFrame:
    """bin, count, good, bad, bad_rate, pct, cum_good_pct, cum_bad_pct, ks; bins without rows are left out."""
    cells = df.groupBy(bin_index(F.col(score), cuts).alias("bin")).agg(
        F.count("*").alias("count"), F.sum(1 - F.col(target)).alias("good"), F.sum(target).alias("bad")
    )
    line, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    part = lambda c, over: 100.0 * F.sum(c).over(over) / F.nullif(F.sum(c).over(whole), F.lit(0))
    return cells.select(
        "bin", "count", "good", "bad", F.round(F.col("bad") / F.col("count"), 4).alias("bad_rate"),
        F.round(100.0 * F.col("count") / F.sum("count").over(whole), 2).alias("pct"),
        F.round(part("good", line), 2).alias("cum_good_pct"), F.round(part("bad", line), 2).alias("cum_bad_pct"),
        F.round(F.abs(part("good", line) - part("bad", line)), 2).alias("ks"),
    )


def score_psi(df: DataFrame, score: str, cuts: list[float], keys: list[str], base: Column) -> DataFrame:
    """keys, psi_score of the rows of each key against those of base, in bins of the training quantiles."""
    own = df.withColumn("_bin", bin_index(F.col(score), cuts)).where("_bin IS NOT NULL")
    expected = own.where(base).groupBy("_bin").agg(F.count("*").alias("expected"))
    actual = own.groupBy(*keys, "_bin").agg(F.count("*").alias("actual"))
    grid = actual.select(*keys).distinct().join(F.broadcast(expected.select("_bin").union(actual.select("_bin")).distinct()))  # keys x bins, both few
    cells = grid.join(expected, "_bin", "left").join(actual, [*keys, "_bin"], "left").fillna(0, ["expected", "actual"])
    return psi_of(cells.where("expected + actual > 0"), keys).withColumnRenamed("psi", "psi_score")


def by_period(df: DataFrame, score: str, target: str, period: Column, cuts: list[float], train: Column, base_ks: float, base_auc: float, threshold: float = 0.5) -> DataFrame:
    """period, n, bad_rate, ks, auc, acc, psi_score, ks_decay, auc_decay. score: a probability of bad."""
    own = df.withColumn("period", period)
    out = ks_auc(own, F.col(score), target, ["period"]).join(accuracy(own, F.col(score), target, ["period"], threshold), "period")
    out = out.join(score_psi(own, score, cuts, ["period"], train), "period")
    decay = lambda name, base, floor: F.round((F.lit(base) - F.col(name)) / F.lit(base), 6) if base > floor else F.lit(None).cast("double")
    return out.withColumns({"ks_decay": decay("ks", base_ks, 0.0), "auc_decay": decay("auc", base_auc, 0.5)})


def predicted(model: Column | str | Callable[[DataFrame], Column] | object, df: DataFrame) -> DataFrame:
    """df with `p`, the probability of bad that a model gives.

    model: a column or its name, a function from the frame to a column, or anything with `transform` as Spark ML's models
    have it; of those, the second element of `probability` counts, or `prediction` where there is none.
    """
    if isinstance(model, str):
        return df.withColumn("p", F.col(model).cast("double"))
    if isinstance(model, Column):
        return df.withColumn("p", model.cast("double"))
    if not hasattr(model, "transform"):
        if not callable(model):
            raise TypeError("a model is a column, a function of the frame, or has transform")
        return df.withColumn("p", model(df).cast("double"))
    out = model.transform(df)
    if "probability" not in out.columns:
        return out.withColumn("p", F.col("prediction").cast("double"))
    if dict(out.dtypes)["probability"] != "vector":
        return out.withColumn("p", F.element_at("probability", 2).cast("double"))
    from pyspark.ml.functions import vector_to_array

    return out.withColumn("p", F.element_at(vector_to_array("probability"), 2))


def evaluate(model: object, train: DataFrame, target: str, test: DataFrame | None = None, oot: DataFrame | None = None, features: list[str] | None = None, n_bins: int = 10, threshold: float = 0.5) -> dict:
    """KS, AUC and accuracy of any model (see predicted) on each sample, losses and PSI, and score_table of the test (or else training) sample."""
    samples = {k: d for k, d in (("train", train), ("test", test), ("oot", oot)) if d is not None}
    parts = [predicted(model, d).select(F.lit(k).alias("sample"), F.round("p", 10).alias("p"), F.col(target).alias("y")) for k, d in samples.items()]
    names = {} if features is None else {"model_vars": features, "n_vars": len(features)}
    return names | evaluate_rows(reduce(DataFrame.union, parts), n_bins, threshold)


def evaluate_rows(rows: DataFrame, n_bins: int = 10, threshold: float = 0.5) -> dict:
    """What evaluate gives, from rows (sample: train, test or oot; p; y)."""
    found = {r["sample"]: r for r in ks_auc(rows, F.col("p"), "y", ["sample"]).join(accuracy(rows, F.col("p"), "y", ["sample"], threshold), "sample").collect()}
    cuts = score_edges(rows.where("sample = 'train'"), "p", n_bins)
    psi = dict(score_psi(rows, "p", cuts, ["sample"], F.col("sample") == "train").collect())
    out: dict = {}
    for name, short in (("train", "trn"), ("test", "test"), ("oot", "oot")):
        if name in found:
            out |= {f"{short}_{k}": found[name][k] for k in ("ks", "auc", "acc")}
    if "test" in found:
        out |= {"ks_reduce": round(out["trn_ks"] - out["test_ks"], 6), "psi": psi["test"]}
        out["ks_rel_gap"] = round(out["ks_reduce"] / out["trn_ks"], 6) if out["trn_ks"] else None
    if "oot" in found:
        out["psi_oot"] = psi["oot"]
    name = "test" if "test" in found else "train"
    out["score_table"] = score_table(rows.where(F.col("sample") == name), "p", "y", cuts)
    return out


def roc_points(df: DataFrame, score: Column, target: str) -> DataFrame:
    """score, fpr, tpr (6 digits) at every distinct threshold, from the highest score down."""
    cells, whole = by_score(df, -score, target, []), Window.partitionBy()
    share = lambda c: F.round(F.sum(c).over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)) / F.sum(c).over(whole), 6)
    return cells.select((-F.col("score")).alias("score"), share("good").alias("fpr"), share("bad").alias("tpr"))


def ks_curve(df: DataFrame, score: Column, target: str) -> DataFrame:
    """score, cum_good, cum_bad, gap (shares of 6 digits) at every distinct score."""
    cells, whole = by_score(df, score, target, []), Window.partitionBy()
    good, bad = F.col("cum_good") / F.sum("good").over(whole), F.col("cum_bad") / F.sum("bad").over(whole)
    return cells.select("score", F.round(good, 6).alias("cum_good"), F.round(bad, 6).alias("cum_bad"), F.round(F.abs(bad - good), 6).alias("gap"))


def histogram(df: DataFrame, score: str, keys: list[str], n_bins: int = 20) -> DataFrame:
    """keys, bin, n over bins of equal width with edges common to all keys; [lo, hi), the last closed."""
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    if lo is None:
        return df.groupBy(*keys, F.lit(0).alias("bin")).agg(F.count("*").alias("n")).where("false")
    width = (hi - lo) / n_bins
    at = F.least(F.floor((F.col(score) - lo) / width), F.lit(n_bins - 1)) if width > 0 else F.lit(0)
    return df.where(F.col(score).isNotNull()).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
