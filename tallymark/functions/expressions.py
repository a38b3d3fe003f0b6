"""Column expressions of the scorecard formulas. Counts are integers and are divided last, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import WOE_ALL_BAD, WOE_FLOOR

PSI_FLOOR = 1e-6
MAX_CASES = 64
"""Cuts that are searched by nested CASE, which is compiled; more by a binary search in an array."""


def is_numeric(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, T.NumericType)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL in all floating columns: aggregates must not turn NaN. Needed once, where data come in."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def usable(column: Column, excluded: Iterable[float] = ()) -> Column:
    """A numeric column as double, NULL for excluded (special) values."""
    value = column.cast("double")
    excluded = list(excluded)
    return F.when(~value.isin(excluded), value) if excluded else value


def bin_index(column: Column, cuts: list[float], right: bool = True) -> Column:
    """Number of cuts below the value (right: bins (lo, hi]) or at most the value (bins [lo, hi)); NULL for NULL."""
    if not cuts:
        return F.when(column.isNotNull(), F.lit(0))
    if len(cuts) > MAX_CASES:  # binary search in a constant array
        steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
        full = F.array(*(F.lit(float(c)) for c in [*cuts, *[float("inf")] * (2 * steps[0] - 1 - len(cuts))]))

        def step(at: Column, by: Column) -> Column:
            cut = F.element_at(full, at + by)
            return at + F.when((cut < column) if right else (cut <= column), by).otherwise(F.lit(0))

        return F.when(column.isNotNull(), F.least(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step), F.lit(len(cuts))))

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        low = (column <= float(cuts[mid])) if right else (column < float(cuts[mid]))
        return F.when(low, search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(column.isNotNull(), search(0, len(cuts)))


def woe(bad: Column, good: Column, all_bad: Column, all_good: Column) -> Column:
    """ln of the ratio of shares: at least WOE_FLOOR, WOE_ALL_BAD without good rows, 0 for no rows or one class overall."""
    one_class = (all_bad == 0) | (all_good == 0) | (bad + good == 0)
    ratio = (bad / F.nullif(all_bad, F.lit(0))) / (F.nullif(good, F.lit(0)) / F.nullif(all_good, F.lit(0)))
    return (
        F.when(one_class, 0.0).when(good == 0, WOE_ALL_BAD).when(bad == 0, WOE_FLOOR)
        .otherwise(F.greatest(F.lit(WOE_FLOOR), F.ln(F.nullif(ratio, F.lit(0.0)))))
    )


def iv(bad: Column, good: Column, all_bad: Column, all_good: Column, weight: Column) -> Column:
    one_class = (all_bad == 0) | (all_good == 0)
    return F.when(one_class, 0.0).otherwise((bad / F.nullif(all_bad, F.lit(0)) - good / F.nullif(all_good, F.lit(0))) * weight)


def psi_term(expected: Column, actual: Column, all_expected: Column, all_actual: Column) -> Column:
    """One bin's part of the population stability index; NULL (so the sum is NULL) if either side is empty."""
    clip = lambda share: F.greatest(F.lit(PSI_FLOOR), F.least(F.lit(1.0), share))
    e = clip(expected / F.nullif(all_expected, F.lit(0)))
    a = clip(actual / F.nullif(all_actual, F.lit(0)))
    e = F.when(all_expected > 0, e)
    a = F.when(all_actual > 0, a)
    return (a - e) * F.ln(a / e)


def long_form(df: DataFrame, columns: dict[str, Column], keep: dict[str, Column]) -> DataFrame:
    """keep, variable, value: a row for each of columns; one pass over df for all."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("variable"), v.alias("value")) for k, v in columns.items())))
    return df.select(*(v.alias(k) for k, v in keep.items()), pairs.alias("_pair")).select(*keep, "_pair.variable", "_pair.value")
