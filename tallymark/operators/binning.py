"""Binning of all columns in one pass: histograms in Spark, merges on the driver on a few dozen rows a variable, tables as DataFrames.

The histogram is taken at the finest cuts a method may keep, with the least and largest value in each; every later cut is one
of these, so merged bins are sums and the data are not read again. Trees are grown over all distinct values. Special values and
NULLs get bins of their own, after the main ones.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.expressions import bin_index, is_numeric, long_form, usable, without_nan
from .passes import Survey, kept
from .profile import MAX_CATEGORIES, number_roles, require_unique
from .trees import Leaf, grow

METHODS = ("chi", "frequency", "distance", "tree")
CATEGORY_MODES = ("woe_per_value", "badrate_merge", "freq_merge")
PREBINS = 50
"""Finest bins of the chi-square method, which takes every value where there are at most so many."""
BIN_SCHEMA = (
    "variable string, bin_no int, kind string, lo double, hi double, levels array<string>, label string, count long, count_bad long, count_good long, "
    "bad_rate double, woe double, iv double, iv_total double, method string, monotonic int, trend_preset int, trend_match boolean, dtype string"
)


@dataclass(frozen=True)
class Settings:
    method: str = "chi"
    n_bins: int = 10
    min_bin_pct: float = 0.05
    min_woe_diff: float = 0.1
    monotonic: object = None
    confidence: float = 3.841
    category_mode: str = "woe_per_value"
    special_values: tuple[float, ...] = ()
    skip_values: tuple[float, ...] = ()
    manual_cutoffs: tuple[float, ...] | None = None
    adjust_shape: bool = True
    missing_combine: str | None = None
    max_categories: int = MAX_CATEGORIES
    min_nobs: float = 30
    top_n: int = 10
    badrate_gap: float = 0.05

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method {self.method!r} is none of {METHODS}")
        if self.category_mode not in CATEGORY_MODES:
            raise ValueError(f"category_mode {self.category_mode!r} is none of {CATEGORY_MODES}")
        if self.missing_combine not in (None, False, "none", "near", "worst"):
            raise ValueError(f"missing_combine {self.missing_combine!r} is none of near, worst, None")
        if self.min_nobs < 0:
            raise ValueError("min_nobs is negative")
        K.trend_code(self.monotonic)


@dataclass
class Bin:
    kind: str
    """main, special or missing"""
    bad: int
    good: int
    lo: float | None = None
    hi: float | None = None
    levels: list[str] | None = None
    value: float | None = None
    woe: float = 0.0
    iv: float = 0.0

    @property
    def label(self) -> str:
        if self.kind == "missing":
            return "missing"
        if self.kind == "special":
            return f"special: {self.value:g}"
        if self.levels is not None:
            more = f" (+{len(self.levels) - 5})" if len(self.levels) > 5 else ""
            return ", ".join(self.levels[:5]) + more
        edge = lambda x: "inf" if x == K.INF else "-inf" if x == -K.INF else f"{x:.4f}"
        return f"({edge(self.lo)}, {edge(self.hi)}]"


@dataclass
class BinTable:
    variable: str
    dtype: str
    method: str
    bins: list[Bin]
    cuts: list[float] = field(default_factory=list)
    monotonic: int = 0
    trend_preset: int = 0
    missing_merged: int | None = None
    """The bin that took the missing rows."""

    @property
    def main(self) -> list[Bin]:
        return [b for b in self.bins if b.kind == "main"]

    @property
    def iv_total(self) -> float:
        return round(sum(b.iv for b in self.bins), 6)

    @property
    def trend_match(self) -> bool | None:
        return None if not self.trend_preset else self.monotonic == self.trend_preset

    def weigh(self) -> BinTable:
        """WOE of 6 digits over all bins, IV from the rounded WOE."""
        bad, good = sum(b.bad for b in self.bins), sum(b.good for b in self.bins)
        for b, (woe, _) in zip(self.bins, K.woe_iv([[0, b.bad, b.good] for b in self.bins]), strict=True):
            b.woe = round(woe, 6) + 0.0  # no negative zero
            b.iv = round((b.bad / bad - b.good / good) * b.woe, 6) + 0.0 if bad and good else 0.0
        return self

    def rows(self) -> list[tuple]:
        total = self.iv_total
        return [
            (self.variable, i, b.kind, b.lo, b.hi, b.levels, b.label, b.bad + b.good, b.bad, b.good,
             round(b.bad / (b.bad + b.good), 6) if b.bad + b.good else 0.0, b.woe, b.iv, total, self.method, self.monotonic, self.trend_preset, self.trend_match, self.dtype)
            for i, b in enumerate(self.bins)
        ]


def _fit_main(name: str, rows: list[tuple], s: Settings, total: int, cuts: list[float] | None, leaves: list[Leaf] | None) -> BinTable:
    """rows: (bin, bad, good, least, largest value) of the clean values; cuts: the histogram's; leaves: of the tree method."""
    trend = K.trend_code(s.monotonic)
    rows = sorted(rows)
    if s.manual_cutoffs is not None or s.method == "distance":
        held = {r[0]: r for r in rows}
        ends = [*cuts, K.INF]
        regroup = [[ends[i], *(held[i][1:3] if i in held else (0, 0))] for i in range(len(ends))]
    elif s.method == "frequency":
        regroup = [[r[4], r[1], r[2]] for r in rows]  # a cut is the largest value up to the quantile
    elif s.method == "chi":
        edges = [*(cuts or ()), K.INF]
        regroup = K.chi_merge([[r[4] if cuts is None else edges[r[0]], r[1], r[2]] for r in rows], s.n_bins, s.confidence)
    else:
        regroup = [[leaf.hi, leaf.bad, leaf.good] for leaf in leaves or ()]
    if regroup:
        regroup[-1] = [K.INF, *regroup[-1][1:]]
    if s.manual_cutoffs is None and s.adjust_shape:
        regroup, found_trend = K.adjust(regroup, total, s.min_bin_pct, s.min_woe_diff, trend)
    else:
        found_trend = K.trend_of(regroup)
    ends = [-K.INF, *(r[0] for r in regroup)]
    bins = [Bin("main", r[1], r[2], lo, r[0]) for lo, r in zip(ends, regroup, strict=False)]
    return BinTable(name, "numeric", "manual" if s.manual_cutoffs is not None else s.method, bins, ends[1:-1], found_trend, trend)


def _fit_levels(name: str, rows: list[tuple[str, int, int]], s: Settings) -> BinTable:
    if s.category_mode == "badrate_merge":
        groups = K.rate_merge(rows, s.min_bin_pct, s.badrate_gap)
    elif s.category_mode == "freq_merge":
        groups = K.frequency_merge(rows, s.top_n)
    else:
        groups = [[x] for x in sorted(r[0] for r in rows)]
    counts = {level: (bad, good) for level, bad, good in rows}
    bins = [Bin("main", sum(counts[x][0] for x in g), sum(counts[x][1] for x in g), levels=g) for g in groups]
    return BinTable(name, "categorical", s.category_mode, bins, trend_preset=K.trend_code(s.monotonic))


def fit(df: DataFrame, target: str, columns: list[str], settings: Settings | None = None, config: dict[str, dict] | None = None) -> dict[str, BinTable]:
    """variable -> table. config: settings by variable, over the common ones. Variables with too few values are left out, with a warning.

    The features and the target are persisted meanwhile. Passes over them: a sample, a survey of all numbers, the few values around
    their cuts, and counts of levels; for trees a shuffle of rows summed by value.
    """
    require_unique(columns, "features")
    with kept(df, without_nan(df).select(*columns, target)) as held:
        return _fit(held, target, columns, settings or Settings(), config or {})


def _fit(df: DataFrame, target: str, columns: list[str], base: Settings, config: dict[str, dict]) -> dict[str, BinTable]:
    own = {c: replace(base, **config.get(c, {})) for c in columns}
    total, low, high, odd = df.agg(F.count("*"), F.min(target), F.max(target), F.count_if(~F.col(target).isin(0, 1) | F.col(target).isNull())).first()
    if odd or (low, high) != (0, 1):
        raise ValueError("the target must have the values 0 and 1, both")
    excluded = {c: [*own[c].special_values, *own[c].skip_values] for c in columns}
    numbers = [c for c in columns if is_numeric(df, c)]
    survey = Survey(df, {c: F.col(c) for c in numbers}, F.col(target), excluded, max(PREBINS, MAX_CATEGORIES), total)
    numeric = number_roles(df, survey)
    levels = [c for c in columns if c not in numeric]
    free = [c for c in numeric if own[c].manual_cutoffs is None]
    by_tree = [c for c in free if own[c].method == "tree"]
    by_value = [c for c in free if own[c].method == "chi" and survey.few[c] is not None and len(survey.few[c]) <= PREBINS]
    edges = survey.edges({c: PREBINS if own[c].method == "chi" else own[c].n_bins for c in free if own[c].method in ("chi", "frequency") and c not in by_value})
    cuts: dict[str, list[float]] = {c: e[1:-1] for c, e in edges.items()}
    for c in numeric:
        if own[c].manual_cutoffs is not None:
            cuts[c] = sorted(float(x) for x in own[c].manual_cutoffs)
        elif own[c].method == "distance":
            lo, hi = survey.range(c) or (0.0, 0.0)
            step = (hi - lo) / own[c].n_bins
            cuts[c] = sorted({round(lo + step * i, 12) for i in range(1, own[c].n_bins)}) if step > 0 else []
    found = survey.histogram(cuts)
    clean = {c: usable(F.col(c), excluded[c]) for c in by_tree}
    leaves = grow(df, target, clean, {c: max(1, int(0.01 * survey.n(c))) for c in by_tree}, {c: own[c].n_bins for c in by_tree})
    counted: dict[str, list[tuple]] = {c: [] for c in levels}
    if levels:
        cells = long_form(df, {c: F.col(c).cast("string") for c in levels}, {"y": F.col(target)}).groupBy("variable", "value")
        for c, level, bad, good in cells.agg(F.sum("y"), F.sum(1 - F.col("y"))).collect():
            counted[c].append((level, bad, good))

    tables = {}
    for c in columns:
        s = own[c]
        if c in numeric:
            if c in by_value:
                rows = [(i, bad, k - bad, x, x) for i, (x, k, bad) in enumerate(survey.few[c])]
            else:
                rows = [(i, bad, k - bad, lo, hi) for i, k, bad, lo, hi in found.get(c, ())]
            apart = [(x, bad, k - bad) for x, k, bad in survey.apart[c] if x in s.special_values]
            n = survey.n(c) + sum(k for _, k, _ in survey.apart[c])
            k, bad = survey.missing[c]
            missing = (bad, k - bad) if k else None
        else:
            special = {f"{v:g}" for v in s.special_values} | {str(v) for v in s.special_values}
            skip = {f"{v:g}" for v in s.skip_values} | {str(v) for v in s.skip_values}
            n = sum(b + g for x, b, g in counted[c] if x is not None)
            rows = [r for r in counted[c] if r[0] is not None and r[0] not in skip]
            apart = [(float(x), b, g) for x, b, g in rows if x in special]
            missing = next(((b, g) for x, b, g in counted[c] if x is None), None)
        least = max(1, int(s.min_nobs * total)) if 0 < s.min_nobs < 1 else s.min_nobs
        if n < least or not (rows or leaves.get(c)):
            warnings.warn(f"{c}: {n} values are too few to bin", stacklevel=3)
            continue
        table = _fit_main(c, rows, s, total, cuts.get(c), leaves.get(c)) if c in numeric else _fit_levels(c, [x for x in rows if x[0] not in special], s)
        table.bins += [Bin("special", b, g, value=v) for v, b, g in sorted(apart)]
        if missing:
            few = missing[0] == 0 or sum(missing) < max(1, int(total * s.min_bin_pct))
            if s.missing_combine in ("near", "worst") and few and table.bins:
                i = K.missing_target([(b.bad, b.good) for b in table.bins], missing, s.missing_combine)
                table.bins[i].bad += missing[0]
                table.bins[i].good += missing[1]
                table.missing_merged = i
            else:
                table.bins.append(Bin("missing", *missing))
        tables[c] = table.weigh()
        if table.trend_match is False:
            warnings.warn(f"{c}: trend {K.TREND_NAMES[table.monotonic]}, not {K.TREND_NAMES[table.trend_preset]}", stacklevel=3)
    return tables


def bin_table(spark: SparkSession, tables: dict[str, BinTable]) -> DataFrame:
    """All tables as one DataFrame, a row for each bin."""
    return spark.createDataFrame([r for t in tables.values() for r in t.rows()], BIN_SCHEMA)


def iv_ranking(spark: SparkSession, tables: dict[str, BinTable]) -> DataFrame:
    rows = sorted(((t.variable, t.iv_total) for t in tables.values()), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "variable string, iv double")


def level_map(table: BinTable, values: list) -> Column:
    pairs = [x for b, v in zip(table.main, values, strict=True) for level in b.levels or () for x in (F.lit(level), F.lit(v))]
    return F.create_map(*pairs)


def main_index(table: BinTable, column: Column) -> Column:
    """The main bin of a value; NULL for NULL and unknown levels."""
    if table.dtype == "categorical":
        return F.try_element_at(level_map(table, list(range(len(table.main)))), column.cast("string"))
    return bin_index(column.cast("double"), table.cuts)


def index_column(table: BinTable, column: Column) -> Column:
    """Number of the bin: main ones, then special ones, then missing; NULL for unknown levels and missing values without a bin."""
    n, out = len(table.main), F.when(F.lit(False), F.lit(0))
    specials = [b for b in table.bins if b.kind == "special"]
    for i, b in enumerate(specials):
        out = out.when(column.cast("double") == b.value, F.lit(n + i))
    if any(b.kind == "missing" for b in table.bins):
        out = out.when(column.isNull(), F.lit(n + len(specials)))
    elif table.missing_merged is not None:
        out = out.when(column.isNull(), F.lit(table.missing_merged))
    return out.otherwise(main_index(table, column))


def transform(df: DataFrame, tables: dict[str, BinTable]) -> DataFrame:
    """df with each binned column replaced by the number of its bin."""
    return without_nan(df).withColumns({c: index_column(t, F.col(c)) for c, t in tables.items()})
