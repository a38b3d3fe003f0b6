"""Rule mining: combinations of up to three binned features by grouping sets, single features by trees, pairs of the best."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import bin_index, without_nan
from ..functions.kernels import INF
from .binning import BinTable
from .passes import Survey, kept
from .profile import quantile_edges
from .trees import grow

METHODS = ("exhaustive", "tree", "apriori")


@dataclass(frozen=True)
class Part:
    """feature in (lo, hi], or missing."""

    feature: str
    lo: float = -INF
    hi: float = INF
    missing: bool = False

    def text(self) -> str:
        if self.missing:
            return f"{self.feature} is missing"
        if self.lo == -INF and self.hi == INF:
            return f"{self.feature} is any"
        if self.lo == -INF:
            return f"{self.feature} <= {self.hi:.2f}"
        if self.hi == INF:
            return f"{self.feature} > {self.lo:.2f}"
        return f"{self.feature} in ({self.lo:.2f}, {self.hi:.2f}]"

    def column(self) -> Column:
        x = F.col(self.feature).cast("double")
        if self.missing:
            return F.col(self.feature).isNull()
        test = x.isNotNull()
        if self.lo != -INF:
            test &= x > self.lo
        if self.hi != INF:
            test &= x <= self.hi
        return F.coalesce(test, F.lit(False))


@dataclass
class Rule:
    parts: tuple[Part, ...]
    hit: int
    bad: int
    lift: float = 0.0
    single: int = 0

    @property
    def text(self) -> str:
        return " AND ".join(p.text() for p in self.parts)

    def column(self) -> Column:
        out = self.parts[0].column()
        for p in self.parts[1:]:
            out &= p.column()
        return out


@dataclass(frozen=True)
class RuleSettings:
    method: str = "exhaustive"
    max_depth: int = 3
    max_tree_depth: int = 4
    min_lift: float = 3.0
    min_hit_rate: float = 0.01
    max_hit_rate: float = 0.20
    max_rules: int = 20

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method {self.method!r} is none of {METHODS}")


def rule_edges(df: DataFrame, features: list[str], tables: dict[str, BinTable] | None) -> dict[str, list[float]]:
    """Inner cuts of each feature: of its table, else its five-quantiles."""
    out = {c: list(tables[c].cuts) for c in features if tables and c in tables}
    rest = [c for c in features if c not in out]
    found = quantile_edges(df, rest, 5)
    return out | {c: e[1:-1] for c, e in found.items()}


def _passing(rules: list[Rule], n: int, bad: int, s: RuleSettings) -> list[Rule]:
    """Rules with a hit rate within the limits and lift enough, with their lift set."""
    out = []
    for r in rules:
        if r.hit and s.min_hit_rate <= r.hit / n <= s.max_hit_rate:
            r.lift = round((r.bad / r.hit) / (bad / n), 4) if bad else 1.0
            if r.lift >= s.min_lift:
                out.append(r)
    return out


def exhaustive(df: DataFrame, target: str, edges: dict[str, list[float]], depth: int, n: int, least: float = 0.0, most: float = 1.0) -> list[Rule]:
    """All cells of up to `depth` features, by grouping sets of the rows summed by all bins; rows with a NULL in a cell's features are in none.

    So the sets multiply distinct combinations of bins, not rows. Cells with too few or too many rows go before they are collected.
    """
    features = sorted(edges)
    binned = df.select(*(bin_index(F.col(c).cast("double"), edges[c]).alias(c) for c in features), F.col(target).alias("_y"))
    sets = [s for k in range(1, depth + 1) for s in combinations(features, k)]
    summed = binned.groupBy(*features).agg(F.count("*").alias("_n"), F.sum("_y").alias("_b"))
    cells = summed.groupingSets([[F.col(c) for c in s] for s in sets], *features).agg(F.grouping_id().alias("_set"), F.sum("_n").alias("_hit"), F.sum("_b").alias("_bad"))
    cells = cells.where((F.col("_hit") >= least * n) & (F.col("_hit") <= most * n))
    out = []
    for row in cells.collect():
        used = [c for i, c in enumerate(features) if not row["_set"] >> (len(features) - 1 - i) & 1]
        if all(row[c] is not None for c in used):
            ends = {c: [-INF, *edges[c], INF] for c in used}
            parts = tuple(Part(c, ends[c][row[c]], ends[c][row[c] + 1]) for c in used)
            if all(p.lo != -INF or p.hi != INF for p in parts):
                out.append(Rule(parts, row["_hit"], int(row["_bad"] or 0)))
    return out


def by_tree(df: DataFrame, target: str, features: list[str], depth: int, n: int) -> list[Rule]:
    """The leaves of a tree on each feature over its distinct values, missing values at the median; they count in no rule."""
    with kept(df, df.select(*features, target)) as held:
        survey = Survey(held, {c: F.col(c) for c in features}, F.col(target))
        medians = survey.order_statistics({c: [(survey.n(c) + 1) // 2 - 1] for c in features if survey.n(c)})
        median = {c: next(iter(v.values())) for c, v in medians.items()}
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in median.items()}
        trees = grow(held, target, filled, dict.fromkeys(filled, max(20, int(0.01 * n))), max_depth=depth)
    out = []
    for c, leaves in trees.items():
        for leaf in leaves if len(leaves) > 1 else ():
            gone, gone_bad = survey.missing[c] if leaf.lo < median[c] <= leaf.hi else (0, 0)
            out.append(Rule((Part(c, leaf.lo, leaf.hi),), leaf.bad + leaf.good - gone, leaf.bad - gone_bad))
    return out


def measured(df: DataFrame, target: str, rules: list[Rule]) -> list[Rule]:
    """Sets hit and bad of each rule; one aggregate for all."""
    if rules:
        row = df.agg(*(x for r in rules for x in (F.count_if(r.column()), F.coalesce(F.sum(F.when(r.column(), F.col(target))), F.lit(0))))).first()
        for i, r in enumerate(rules):
            r.hit, r.bad = int(row[2 * i]), int(row[2 * i + 1])
    return rules


def single_hits(df: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Sets how many rows each rule hits that no other rule hits."""
    if rules:
        hits = F.array(*(F.when(r.column(), F.lit(i)) for i, r in enumerate(rules)))
        only = df.select(F.array_compact(hits).alias("h")).where(F.size("h") == 1).groupBy(F.col("h")[0]).count().collect()
        for i, k in only:
            rules[i].single = k
    return rules


def mine(df: DataFrame, target: str, features: list[str], settings: RuleSettings | None = None, tables: dict[str, BinTable] | None = None) -> list[Rule]:
    """Rules by lift, then text; single hits are counted among all of them before the best are taken."""
    s, df = settings or RuleSettings(), without_nan(df)
    n, bad, odd = df.agg(F.count("*"), F.sum(target), F.count_if(~F.col(target).isin(0, 1))).first()
    if odd:
        warnings.warn("the target has values other than 0 and 1", stacklevel=2)
    if not n:
        return []
    rules = measured(df, target, [Rule((Part(c, missing=True),), 0, 0) for c in features])
    if s.method == "tree":
        rules += by_tree(df, target, features, s.max_tree_depth, n)
    else:
        depth = 1 if s.method == "apriori" else s.max_depth
        rules += exhaustive(df, target, rule_edges(df, features, tables), depth, n, s.min_hit_rate, s.max_hit_rate)
    found = _passing(rules, n, bad, s)
    if s.method == "apriori":
        top = sorted((r for r in found if not r.parts[0].missing), key=lambda r: (-r.lift, r.text))[:10]
        pairs = [Rule(a.parts + b.parts, 0, 0) for a, b in combinations(top, 2) if a.parts[0].feature != b.parts[0].feature]
        found += _passing(measured(df, target, pairs), n, bad, s)
    found.sort(key=lambda r: (-r.lift, r.text))
    return single_hits(df, found)[: s.max_rules]


def rules_table(spark: SparkSession, rules: list[Rule], n: int, bad: int) -> DataFrame:
    rows = [
        (r.text, r.hit, r.bad, r.hit - r.bad, round(r.hit / n, 6), round(r.bad / r.hit, 6) if r.hit else 0.0, round(r.bad / bad, 6) if bad else 0.0, r.lift, r.single, round(r.single / n, 6))
        for r in rules
    ]
    return spark.createDataFrame(rows, "rule string, hit_count long, bad_count long, good_count long, hit_rate double, precision double, recall double, lift double, single_hit_count long, single_hit_rate double")


def used_features(rules: list[Rule]) -> list[str]:
    return sorted({p.feature for r in rules for p in r.parts})


def coverage(df: DataFrame, target: str, rules: list[Rule]) -> DataFrame:
    """rule, cum_hit, cum_recall, cum_bad_rate of the union of the rules from the top down: each row counts at its first rule."""
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        rank = F.when(rules[i].column(), F.lit(i)).otherwise(rank)
    rows = {r[0]: (r[1], int(r[2] or 0)) for r in df.groupBy(rank.alias("rank")).agg(F.count("*"), F.sum(target)).collect()}
    bad = sum(b for _, b in rows.values())
    out, hit, hit_bad = [], 0, 0
    for i, r in enumerate(rules):
        hit, hit_bad = hit + rows.get(i, (0, 0))[0], hit_bad + rows.get(i, (0, 0))[1]
        out.append((r.text, hit, round(hit_bad / bad, 6) if bad else 0.0, round(hit_bad / hit, 6) if hit else 0.0))
    return df.sparkSession.createDataFrame(out, "rule string, cum_hit long, cum_recall double, cum_bad_rate double")
