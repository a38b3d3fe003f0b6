"""Profiling: roles, column statistics, association with the target, target by period. One or two passes for all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import is_numeric, long_form, usable, without_nan
from .passes import AT_ONCE, MAIN, MANY, VALUE, Survey, histograms, kept

MAX_CATEGORIES, CATEGORY_SHARE = 20, 0.05
SPECIAL_VALUES = (-999.0, -998.0, -1.0, 999999999.0)  # fixed values


def require_unique(names: list[str], what: str = "column labels") -> None:
    if len(set(names)) != len(names):
        raise ValueError(f"{what} repeat: {sorted({n for n in names if names.count(n) > 1})}")


def as_text(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    return {c: F.col(c).cast("string") for c in columns}


def typed(df: DataFrame, column: str, value: Column | None = None) -> Column:
    """A value for grouping columns of several types together: numbers as they are, all else as text."""
    kind, x = df.schema[column].dataType, F.col(column) if value is None else value
    whole, floating = isinstance(kind, T.IntegralType), isinstance(kind, (T.DoubleType, T.FloatType))
    return F.struct(
        (x.cast("long") if whole else F.lit(None).cast("long")).alias("whole"), (x.cast("double") if floating else F.lit(None).cast("double")).alias("real"),
        (F.lit(None).cast("string") if whole or floating else x.cast("string")).alias("text"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, known (the value is not NULL), n: a row for each value. Summed before the shuffle; one shuffle for all columns."""
    cells = long_form(df, {str(i): typed(df, c) for i, c in enumerate(columns)}, {}).select(F.col("variable").cast("int").alias("i"), "value.*")
    names = F.array(*map(F.lit, columns))
    cells = cells.groupBy("i", "whole", "real", "text").agg(F.count("*").alias("n"))
    return cells.select(F.get(names, F.col("i")).alias("variable"), (F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()).alias("known"), "n")


def as_number(df: DataFrame, column: str) -> Column:
    """A double that is as distinct as the column: numbers, dates and times; NULL for other types."""
    kind, x = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("double")
    return x.cast("timestamp").cast("double") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else x.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")


def distinct_up_to(df: DataFrame, columns: list[str], limit: int) -> dict[str, tuple[int, int]]:
    """column -> (values that are not NULL, distinct ones), the latter exact up to the limit and else above it; of text columns 0."""
    found = histograms(df, {c: as_number(df, c) for c in columns}, dict.fromkeys(columns, []), few=limit)
    out = {}
    for c in columns:
        values = sum(r.kind == VALUE for r in found[c])
        out[c] = sum(r.n for r in found[c] if r.kind == MAIN), limit + 1 if any(r.kind == MANY for r in found[c]) else values
    return out


def number_roles(df: DataFrame, survey: Survey) -> list[str]:
    """The columns of a survey (with few set to MAX_CATEGORIES or more) that are numeric, not categorical."""
    out = []
    for c in survey.names:
        values = survey.few[c]
        distinct = MAX_CATEGORIES + 1 if values is None else len(values) + len(survey.apart[c])
        if is_numeric(df, c) and not is_categorical(df, c, survey.n(c) + sum(r[1] for r in survey.apart[c]), distinct):
            out.append(c)
    return out


def is_categorical(df: DataFrame, column: str, n: int, distinct: int, max_categories: int = MAX_CATEGORIES) -> bool:
    """Booleans and text are categorical, and so are numbers with few values for their rows."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.BooleanType, T.StringType)):
        return True
    return n > 0 and distinct <= min(max_categories, int(n * CATEGORY_SHARE))


def roles(df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES) -> dict[str, str]:
    """column -> "categorical", "numeric" or "other" (such as times with many values)."""
    require_unique(columns)
    counts = distinct_up_to(df, columns, max_categories)
    out = {}
    for c in columns:
        n, distinct = counts.get(c, (0, 0))
        out[c] = "categorical" if is_categorical(df, c, n, distinct, max_categories) else "numeric" if is_numeric(df, c) else "other"
    return out


def detect(df: DataFrame, target: str | None = None, special_values: dict[str, list[float]] | None = None, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """A row for each column but the target: type, counts, shares in percent (2 digits), and for numbers their distribution.

    Numbers: mean and deviation of 4 digits, extremes and quartiles with linear interpolation. special_pct_valid is NULL for
    columns without special values.
    """
    columns = [c for c in df.columns if c != target]
    with kept(df, without_nan(df)) as held:
        out = _detected(held, columns, roles(held, columns, max_categories), special_values or {})
        return df.sparkSession.createDataFrame(out.collect(), out.schema)


def _detected(df: DataFrame, columns: list[str], own: dict[str, str], specials: dict[str, list[float]]) -> DataFrame:
    numbers = [c for c in columns if own[c] == "numeric"]
    quartiles = quantile_values(df, numbers, [0.25, 0.5, 0.75])
    counted = value_counts(df, columns).groupBy("variable").agg(
        F.sum("n").alias("count"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("_valid"),
        F.count_if("known").alias("n_unique"), F.max(F.when(F.col("known"), F.col("n"))).alias("_mode"),
    )
    measures = {}
    for c in columns:
        x = F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")
        special = F.sum(F.col(c).cast("double").isin(specials[c]).cast("long")) if specials.get(c) else F.lit(0).cast("long")
        q = F.array(*map(F.lit, quartiles[c])) if quartiles.get(c) else F.lit(None).cast("array<double>")
        measures[c] = F.struct(
            F.lit(c).alias("variable"), F.lit(own[c]).alias("dtype"), F.coalesce(special, F.lit(0)).alias("_special"), F.lit(bool(specials.get(c))).alias("_has"),
            F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.first(q).alias("_q"), F.max(x).alias("max"),
        )
    measured = df.agg(F.array(*measures.values()).alias("m")).select(F.inline("m"))
    percent = lambda part, whole: F.round(100.0 * part / F.nullif(whole, F.lit(0)), 2)
    return measured.join(counted, "variable").select(
        "variable", "dtype", "count", "n_unique", (F.col("count") - F.col("_valid")).alias("missing"),
        percent(F.col("count") - F.col("_valid"), F.col("count")).alias("missing_pct"), percent(F.col("_mode"), F.col("_valid")).alias("one_value_pct"),
        percent(F.col("_special"), F.col("count")).alias("special_pct"), F.when(F.col("_has"), percent(F.col("_special"), F.col("_valid"))).alias("special_pct_valid"),
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", F.get("_q", F.lit(0)).alias("p25"), F.get("_q", F.lit(1)).alias("p50"), F.get("_q", F.lit(2)).alias("p75"), "max",
    )


def reader_summary(df: DataFrame, exclude: list[str]) -> DataFrame:
    """variable, dtype, n_missing, missing_pct, n_unique of the features."""
    df = without_nan(df)
    columns = [c for c in df.columns if c not in exclude]
    kinds = F.create_map(*(x for c in columns for x in (F.lit(c), F.lit(dict(df.dtypes)[c]))))
    counted = value_counts(df, columns).groupBy("variable").agg(
        F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("n_missing"), F.sum("n").alias("_n"), F.count_if("known").alias("n_unique")
    )
    share = F.round(100.0 * F.col("n_missing") / F.col("_n"), 2).alias("missing_pct")
    return counted.select("variable", kinds[F.col("variable")].alias("dtype"), "n_missing", share, "n_unique").orderBy(F.desc("missing_pct"), "variable")


def pearson_with_target(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """variable, target_pearson (6 digits) over rows with both; NULL where either side does not vary."""
    y = F.col(target).cast("double")
    parts = []
    for c in columns:
        x = F.when(y.isNotNull(), F.col(c).cast("double"))
        z = F.when(x.isNotNull(), y)
        varies = (F.min(x) < F.max(x)) & (F.min(z) < F.max(z))
        parts.append(F.struct(F.lit(c).alias("variable"), F.when(varies, F.round(F.corr(x, z), 6)).alias("target_pearson")))
    return without_nan(df).agg(F.array(*parts).alias("p")).select(F.inline("p"))


def cramers_v(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """variable, target_cramers_v (6 digits, no correction); 0 where either side does not vary, NULL with fewer than two rows.

    chi-square = n (sum of o^2 / (row * column) - 1), which needs no empty cells.
    """
    cells = long_form(df, as_text(df, columns), {"y": F.col(target)}).where("value IS NOT NULL AND y IS NOT NULL").groupBy("variable", "value", "y").agg(F.count("*").alias("o"))
    by = lambda *c: Window.partitionBy("variable", *c)
    cells = cells.withColumns({"r": F.sum("o").over(by("value")), "c": F.sum("o").over(by("y"))})
    each = cells.groupBy("variable").agg(
        F.sum("o").alias("n"), F.sum((F.col("o") * F.col("o")).cast("double") / (F.col("r") * F.col("c"))).alias("s"),
        F.count_distinct("value").alias("k"), F.count_distinct("y").alias("l"),
    )
    side = F.least("k", "l") - 1
    chi = F.greatest(F.lit(0.0), F.col("n") * (F.col("s") - 1))
    return each.select("variable", F.when(F.col("n") < 2, None).when(side == 0, 0.0).otherwise(F.round(F.sqrt(chi / (F.col("n") * F.nullif(side, F.lit(0)))), 6)).alias("target_cramers_v"))


def target_by(df: DataFrame, period: Column, target: str) -> DataFrame:
    """period, n (rows with a target) and bad_rate (4 digits)."""
    return df.groupBy(period.alias("period")).agg(F.count(target).alias("n"), F.round(F.avg(F.col(target).cast("double")), 4).alias("bad_rate"))


def quantile_values(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float]]:
    return Survey(df, {c: F.col(c) for c in columns}).quantiles(dict.fromkeys(columns, probs))


def quantile_edges(df: DataFrame, columns: list[str], n_bins: int, at_once: int = AT_ONCE) -> dict[str, list[float]]:
    """Distinct quantiles (linear interpolation) of each column at 0, 1/n, ..., 1, NULLs left out. Exact."""
    return Survey(df, {c: F.col(c) for c in columns}, at_once=at_once).edges(dict.fromkeys(columns, n_bins))


def quick_iv(df: DataFrame, target: str, columns: list[str], max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """variable, iv (6 digits): over raw levels for categories and up to five values, else over ten quantile bins.

    Only bins with both classes count, without caps; 0 for one class or one bin. Rows with a NULL on either side are left out.
    """
    with kept(df, without_nan(df).where(F.col(target).isNotNull()).select(*columns, target)) as held:
        survey = Survey(held, {c: F.col(c) for c in columns if is_numeric(held, c)}, F.col(target), few=max(10, max_categories))
        numbers = {c: (survey.n(c), max_categories + 1 if survey.few[c] is None else len(survey.few[c])) for c in survey.names}
        binned = [c for c, size in numbers.items() if not is_categorical(held, c, *size, max_categories) and size[1] > 5]
        levels = [c for c in columns if c not in binned]
        edges = survey.edges({c: min(10, max(2, numbers[c][1])) for c in binned})
        rows = [(c, str(i), bad, n - bad) for c, bins in survey.histogram({c: edges[c][1:-1] for c in binned}).items() for i, n, bad, *_ in bins]
        cells = df.sparkSession.createDataFrame(rows, "variable string, value string, bad long, good long")
        if levels:
            own = long_form(held, as_text(held, levels), {"y": F.col(target)}).where("value IS NOT NULL").groupBy("variable", "value")
            cells = cells.union(own.agg(F.sum("y").cast("long"), F.sum(1 - F.col("y")).cast("long")))
        whole = Window.partitionBy("variable")
        cells = cells.withColumns({"b": F.sum("bad").over(whole), "g": F.sum("good").over(whole)})
        both = (F.col("bad") > 0) & (F.col("good") > 0)
        b, g = F.col("bad") / F.col("b"), F.col("good") / F.col("g")
        out = cells.groupBy("variable").agg(F.round(F.coalesce(F.sum(F.when(both, (b - g) * F.ln(b / g))), F.lit(0.0)), 6).alias("iv"))
        return df.sparkSession.createDataFrame(out.collect(), out.schema)
