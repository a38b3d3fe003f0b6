"""Weight-of-evidence encoding: column expressions made of the bin tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bin_index, without_nan
from .binning import BinTable, level_map

UNSEEN = ("worst", "most_common", "missing", "zero")


def fallback(table: BinTable, strategy: str = "worst") -> float:
    """WOE of a level that the table does not know: of the main bin of highest bad rate, of the largest one, of missing rows, or 0."""
    if strategy not in UNSEEN:
        raise ValueError(f"unseen strategy {strategy!r} is none of {UNSEEN}")
    if strategy == "missing":
        return missing_woe(table)
    if strategy == "zero" or not table.main:
        return 0.0
    if strategy == "worst":
        return max(table.main, key=lambda b: b.bad / (b.bad + b.good) if b.bad + b.good else 0.0).woe
    return max(table.main, key=lambda b: b.bad + b.good).woe


def missing_woe(table: BinTable, follow_merge: bool = False) -> float:
    """Of the missing bin; without one 0, or with follow_merge that of the bin that took the missing rows."""
    for b in table.bins:
        if b.kind == "missing":
            return b.woe
    return table.bins[table.missing_merged].woe if follow_merge and table.missing_merged is not None else 0.0


def woe_column(table: BinTable, column: Column, strategy: str = "worst", follow_merge: bool = False) -> Column:
    """The WOE of a value: special values first, NULL as missing, then the main bins."""
    unseen = F.lit(fallback(table, strategy))
    if table.dtype == "categorical":
        known = F.try_element_at(level_map(table, [b.woe for b in table.main]), column.cast("string")) if table.main else F.lit(None)
        main = F.coalesce(known, unseen)
    else:
        weights = F.array(*(F.lit(b.woe) for b in table.main))
        main = F.coalesce(F.get(weights, bin_index(column.cast("double"), table.cuts)), unseen)
    out = F.when(column.isNull(), F.lit(missing_woe(table, follow_merge)))
    for b in table.bins:
        if b.kind == "special":
            out = out.when(column.try_cast("double") == b.value, F.lit(b.woe))
    return out.otherwise(main)


def woe_transform(df: DataFrame, tables: dict[str, BinTable], strategy: str = "worst", follow_merge: bool = False) -> DataFrame:
    """df with the binned columns replaced by their WOE, others as they are; no shuffle."""
    return without_nan(df).withColumns({c: woe_column(t, F.col(c), strategy, follow_merge) for c, t in tables.items() if c in df.columns})
