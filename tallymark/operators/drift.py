"""Drift: population stability between samples, and of columns over periods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import bin_index, is_numeric, long_form, psi_term, usable, without_nan
from ..functions.kernels import vifs
from .passes import MAIN, Survey, histograms, kept
from .profile import MAX_CATEGORIES, as_text, distinct_up_to, number_roles, quantile_edges, roles

UNSEEN = "__unseen__"


def psi_of(cells: DataFrame, keys: list[str], expected: str = "expected", actual: str = "actual") -> DataFrame:
    """keys, psi (6 digits) from a count per bin on either side; NULL where a side is empty."""
    whole = Window.partitionBy(*keys)
    cells = cells.withColumns({"_e": F.sum(expected).over(whole), "_a": F.sum(actual).over(whole)})
    term = psi_term(F.col(expected), F.col(actual), F.col("_e"), F.col("_a"))
    return cells.withColumn("_t", term).groupBy(*keys).agg(F.round(F.sum("_t"), 6).alias("psi"))


def psi_table(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """variable, psi: bins from train (levels for categories and up to five values, else ten quantile bins); what train does
    not have is one bin, and so are values outside its range. NULLs are left out."""
    test = without_nan(test).select(*columns)
    with kept(train, without_nan(train).select(*columns)) as train:
        survey = Survey(train, {c: F.col(c) for c in columns if is_numeric(train, c)}, few=MAX_CATEGORIES)
        binned = [c for c in number_roles(train, survey) if survey.few[c] is None or len(survey.few[c]) > 5]
        levels = [c for c in columns if c not in binned]
        edges = survey.edges(dict.fromkeys(binned, 10))
        cuts = {c: [math.nextafter(edges[c][0], -math.inf), *(edges[c][1:] or edges[c])] for c in binned if edges[c]}  # the first and last bins lie outside
        name = lambda c, i: UNSEEN if i in (0, len(cuts[c])) else str(i)
        rows = [(c, name(c, i), n, 0) for c, bins in survey.histogram(cuts).items() for i, n, *_ in bins]
        rows += [(c, name(c, int(r.at)), 0, r.n) for c, bins in histograms(test, {c: F.col(c) for c in cuts}, cuts).items() for r in bins if r.kind == MAIN]
        cells = train.sparkSession.createDataFrame(rows, "variable string, value string, expected long, actual long")
        if levels:
            by_level = lambda df, side: long_form(df, as_text(df, levels), {"side": F.lit(side)}).where("value IS NOT NULL")
            own = by_level(train, 0).union(by_level(test, 1)).groupBy("variable", "value")
            cells = cells.union(own.agg(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)))
        known = F.when((F.col("expected") > 0) | (F.col("value") == UNSEEN), F.col("value")).otherwise(F.lit(UNSEEN))
        cells = cells.groupBy("variable", "value").agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
        cells = cells.groupBy("variable", known.alias("value")).agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
        out = psi_of(cells, ["variable"])
        return train.sparkSession.createDataFrame(out.collect(), out.schema)


def stability(df: DataFrame, target: str, period: Column, columns: list[str], n_bins: int = 5, trend: float = 0.5, psi_warn: float = 0.1, open_ended: bool = False) -> DataFrame:
    """variable, time_period, n, bad_rate, bad_rate_change, psi_vs_first, psi_vs_prev, mean, std, psi_flag, bad_rate_flag.

    Bins come from the first period (all levels for categories, its values if there are few, else its quantiles); values outside
    its range are left out of the distributions unless open_ended. One pass for counts by (variable, period, bin).
    """
    df = without_nan(df).withColumn("_period", period).where("_period IS NOT NULL")
    first, last = df.agg(F.min("_period"), F.max("_period")).first()
    if first is None or first == last:
        raise ValueError("stability needs two periods at least")
    own = roles(df, columns)
    base = df.where(F.col("_period") == F.lit(first))
    few = distinct_up_to(base, columns, n_bins)
    binned = [c for c in columns if own[c] == "numeric" and few[c][1] > n_bins]
    edges = quantile_edges(base, binned, n_bins)

    def value(c: str) -> Column:
        if c not in binned:
            return F.col(c).cast("string")
        x, e = usable(F.col(c)), edges[c]
        inside = F.lit(True) if open_ended else x.between(e[0], e[-1])
        return F.when(inside, bin_index(x, e[1:-1]).cast("string"))

    numbers = lambda c: F.col(c).cast("double") if own[c] == "numeric" else F.lit(None).cast("double")
    pairs = {c: F.struct(value(c).alias("bin"), numbers(c).alias("x")) for c in columns}
    cells = long_form(df, pairs, {"period": F.col("_period"), "y": F.col(target)})
    by_period = cells.groupBy("variable", "period").agg(
        F.count("y").alias("n"), F.sum("y").alias("bad"), F.avg("value.x").alias("mean"), F.stddev_samp("value.x").alias("std")
    )
    bins = cells.where("value.bin IS NOT NULL").groupBy("variable", "period", F.col("value.bin").alias("bin")).agg(F.count("*").alias("k"))
    grid = bins.select("variable", "bin").distinct().join(bins.select("variable", "period").distinct(), "variable")
    bins = grid.join(bins, ["variable", "period", "bin"], "left").fillna(0, ["k"])
    line = Window.partitionBy("variable", "bin").orderBy("period")
    bins = bins.withColumns({"k_first": F.first("k").over(line), "k_prev": F.lag("k").over(line)})
    vs = lambda other, name: psi_of(bins.where(F.col(other).isNotNull()), ["variable", "period"], other, "k").withColumnRenamed("psi", name)
    out = by_period.join(vs("k_first", "psi_vs_first"), ["variable", "period"], "left").join(vs("k_prev", "psi_vs_prev"), ["variable", "period"], "left")
    rate = F.round(F.col("bad") / F.nullif("n", F.lit(0)), 4)
    time = Window.partitionBy("variable").orderBy("period")
    out = out.withColumn("bad_rate", rate).withColumn("_first", F.first("bad_rate").over(time)).withColumn("_no", F.row_number().over(time))
    change = F.when(F.col("_first") > 0, F.round((F.col("bad_rate") - F.col("_first")) / F.col("_first"), 4))
    out = out.withColumn("bad_rate_change", F.when(F.col("_no") > 1, change))
    later = F.col("_no") > 1
    return out.select(
        "variable", F.col("period").alias("time_period"), "n", "bad_rate", "bad_rate_change", F.when(later, F.col("psi_vs_first")).alias("psi_vs_first"), "psi_vs_prev",
        F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
        F.when(~later, "baseline").when(F.col("psi_vs_first") > psi_warn, "unstable").otherwise("stable").alias("psi_flag"),
        F.when(~later, "baseline").when(F.col("bad_rate_change") > trend, "trending_up").when(F.col("bad_rate_change") < -trend, "trending_down").otherwise("stable").alias("bad_rate_flag"),
    )


def stability_summary(result: DataFrame, periods: list, metric: str = "bad_rate") -> DataFrame:
    """A row for each variable: the metric by period, and the latest flags."""
    wide = result.groupBy("variable").pivot("time_period", periods).agg(F.first(metric))
    latest = result.groupBy("variable").agg(F.max_by("psi_flag", "time_period").alias("psi_flag"), F.max_by("bad_rate_flag", "time_period").alias("bad_rate_flag"))
    return wide.join(latest, "variable")


def correlations(df: DataFrame, columns: list[str], threshold: float = 0.7, method: str = "pearson") -> DataFrame:
    """var1, var2, corr (4 digits, absolute, at least the threshold) of pairs of columns, over rows with both.

    pearson: all pairs in one aggregate. spearman: of average ranks, kendall: tau-b, both from counts of value pairs; a value that
    most rows share is one row there.
    """
    df = without_nan(df)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if method == "pearson":
        parts = []
        for a, b in pairs:
            x = F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
            y = F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
            varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
            parts.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.when(varies, F.abs(F.corr(x, y))).alias("corr")))
        out = df.agg(F.array(*parts).alias("p")).select(F.inline("p")) if parts else df.sparkSession.createDataFrame([], "var1 string, var2 string, corr double")
    elif method in ("spearman", "kendall"):
        out = None
        for a, b in pairs:
            cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count("*").alias("n"))
            one = (_spearman if method == "spearman" else _kendall)(cells)
            one = one.select(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.abs("corr").alias("corr"))
            out = one if out is None else out.union(one)
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.where(F.round("corr", 10) >= threshold).withColumn("corr", F.round("corr", 4)).orderBy(F.desc("corr"), "var1", "var2")


def _spearman(cells: DataFrame) -> DataFrame:
    for c in ("x", "y"):
        side = cells.groupBy(c).agg(F.sum("n").alias("m"))
        ranks = side.select(c, (F.sum("m").over(Window.orderBy(c)) - (F.col("m") - 1) / 2).alias(f"r{c}"))
        cells = cells.join(ranks, c)
    n, x, y = F.sum("n"), F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    xy, xx, yy = (F.sum(F.col("n") * F.col(a) * F.col(b)) for a, b in (("rx", "ry"), ("rx", "rx"), ("ry", "ry")))
    sums = cells.agg(n.alias("n"), x.alias("x"), y.alias("y"), xy.alias("xy"), xx.alias("xx"), yy.alias("yy"))
    below = F.sqrt((F.col("n") * F.col("xx") - F.col("x") ** 2) * (F.col("n") * F.col("yy") - F.col("y") ** 2))
    return sums.select(((F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(below, F.lit(0.0))).alias("corr"))


def _kendall(cells: DataFrame) -> DataFrame:
    """tau-b: concordant less discordant pairs of cells, by one join of the distinct values of y with running counts over x.

    For every y the counts of smaller and larger y at smaller x are needed; they come from the table of (x, y) cells, whose size
    is the product of the distinct values, so this is for columns of some thousand values at most.
    """
    a, b = cells.alias("a"), cells.alias("b")
    signs = a.join(b, F.col("a.x") < F.col("b.x")).agg(
        F.sum(F.col("a.n").cast("double") * F.col("b.n") * F.signum(F.col("b.y") - F.col("a.y"))).alias("s")
    )
    ties = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2).alias(f"t{c}"))
    total = cells.agg((F.sum("n").cast("double") * (F.sum("n") - 1) / 2).alias("p"))
    one = lambda d: d.withColumn("_k", F.lit(1))
    row = one(signs).join(one(ties("x")), "_k").join(one(ties("y")), "_k").join(one(total), "_k")
    below = F.sqrt((F.col("p") - F.col("tx")) * (F.col("p") - F.col("ty")))
    return row.select((F.col("s") / F.nullif(below, F.lit(0.0))).alias("corr"))


def vif(df: DataFrame, columns: list[str], threshold: float = 10.0) -> DataFrame:
    """variable, vif (4 digits), flag over complete rows, from the correlation matrix. Constant columns are left out.

    The matrix is the only thing that reaches the driver; all of it comes from one aggregate.
    """
    import numpy as np

    values = {c: F.when(F.abs(F.col(c).cast("double")) != float("inf"), F.col(c).cast("double")) for c in columns}
    rows = without_nan(df).select(*(v.alias(c) for c, v in values.items())).na.drop()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    varies = lambda c: F.min(c) < F.max(c)
    row = rows.agg(*(varies(c) for c in columns), *(F.when(varies(a) & varies(b), F.corr(a, b)) for a, b in pairs)).first()
    used = [c for c, v in zip(columns, row, strict=False) if v]
    at = dict(zip(pairs, list(row)[len(columns) :], strict=True))
    matrix = np.array([[1.0 if a == b else at.get((a, b), at.get((b, a))) for b in used] for a in used])
    found = vifs(matrix) if used else []
    out = sorted(((c, round(v, 4), "high" if v > threshold else "ok") for c, v in zip(used, found, strict=True)), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(out, "variable string, vif double, flag string")
