"""All queries of the scorecard engine over the loans view, and their SQL.

Kernels that merge step by step (chi-square, trees, trends, stepwise) have no SQL; tests compare them with plain versions.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import bin_index
from ..functions.kernels import INF
from ..operators import binning, diagnosis, drift, metrics, monitoring, profile, rules, scorecard, screening, splitting, woe
from ..operators.binning import Settings
from ..operators.passes import kept
from ..operators.quality_report import quality
from .chain import Chain
from .loans import CATEGORIES, CONTINUOUS, FEATURES, LOANS_SQL, NUMERIC, SPECIALS, loans, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QTY_CUTS, TAX_CUTS = (10.0, 20.0, 30.0, 40.0), (0.02, 0.04, 0.06)
RULE_CUTS = {"qty": [10.0, 20.0, 30.0, 40.0], "disc": [2.0, 5.0, 8.0], "tax": [0.02, 0.04, 0.06]}
BIN_COLUMNS = ["variable", "bin_no", "kind", "count", "count_bad", "bad_rate", "woe", "iv", "iv_total"]


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, loans) under its name, with SQL that may read the view loans."""

    def register(f: Callable[[SparkSession, DataFrame], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, loans(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH loans AS ({LOANS_SQL}), {sql.strip().removeprefix('WITH ')}" if sql.strip().startswith("WITH ") else f"WITH loans AS ({LOANS_SQL}) {sql}"
        return f

    return register


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def long_sql(columns: list[str], kind: str = "VARCHAR", where: str = "true") -> str:
    return union_all([f"SELECT '{c}' AS variable, CAST({c} AS {kind}) AS v, bad, yr FROM loans WHERE {where}" for c in columns])


WOE_SQL = (
    "CASE WHEN all_bad = 0 OR all_good = 0 OR count = 0 THEN 0 WHEN count = count_bad THEN 20 WHEN count_bad = 0 THEN -2 "
    "ELSE greatest(-2, ln((count_bad / all_bad) / ((count - count_bad) / all_good))) END"
)


def bins_sql(cuts: str, columns: list[str], special: bool = True) -> str:
    """Bins of numeric columns; cuts: an aggregate of x that gives a list."""
    x = "CASE WHEN v = -999 THEN NULL ELSE v END" if special else "v"
    return f"""WITH long AS ({long_sql(columns, 'DOUBLE')}), clean AS (SELECT variable, {x} AS x, v, bad FROM long),
cuts AS (SELECT variable, {cuts} AS c FROM clean GROUP BY variable),
b AS (SELECT variable, CASE WHEN x IS NOT NULL THEN 'main' WHEN v IS NULL THEN 'missing' ELSE 'special' END AS kind,
  CASE WHEN x IS NOT NULL THEN len(list_filter(c, lambda e: e < x)) END AS i, bad FROM clean JOIN cuts USING (variable)),
h AS (SELECT variable, kind, i, count(*) AS count, sum(bad) AS count_bad FROM b GROUP BY ALL), {weigh_sql()}"""


def weigh_sql(order: str = "CASE kind WHEN 'main' THEN 0 WHEN 'special' THEN 1 ELSE 2 END, i") -> str:
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY {order}) - 1 AS bin_no,
  sum(count_bad) OVER (PARTITION BY variable) AS all_bad, sum(count - count_bad) OVER (PARTITION BY variable) AS all_good FROM h),
e AS (SELECT *, round({WOE_SQL}, 6) + 0.0 AS woe FROM n),
f AS (SELECT *, round((count_bad / all_bad - (count - count_bad) / all_good) * woe, 6) + 0.0 AS iv FROM e)
SELECT variable, CAST(bin_no AS INT) AS bin_no, kind, count, CAST(count_bad AS BIGINT) AS count_bad, round(count_bad / count, 6) AS bad_rate,
  CAST(woe AS DOUBLE) AS woe, CAST(iv AS DOUBLE) AS iv, round(sum(CAST(iv AS DOUBLE)) OVER (PARTITION BY variable), 6) AS iv_total FROM f"""


def quantile_cuts(n: int) -> str:
    return f"list_sort(list_distinct(quantile_cont(x, [{', '.join(repr(i / n) for i in range(n + 1))}])))[2:-2]"


def table_of(spark: SparkSession, df: DataFrame, columns: list[str], config: dict | None = None, **settings: object) -> DataFrame:
    return binning.bin_table(spark, binning.fit(df, "bad", columns, Settings(**settings), config)).select(*BIN_COLUMNS)


# Profiling


@query("SELECT yr, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad, count(*) - count(qty) AS qty_missing, CAST(sum(CASE WHEN qty = -999 THEN 1 ELSE 0 END) AS BIGINT) AS qty_special FROM loans GROUP BY yr")
def loans_view_counts(spark: SparkSession, df: DataFrame) -> DataFrame:
    return df.groupBy("yr").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.count_if(F.col("qty").isNull()).alias("qty_missing"), F.count_if(F.col("qty") == -999).alias("qty_special"))


@query(bins_sql(quantile_cuts(10), ["price"]))
def woe_iv_equalfreq(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, ["price"], method="frequency", n_bins=10, adjust_shape=False, special_values=SPECIALS)


QUICK_SQL = f"""WITH long AS ({long_sql(CONTINUOUS, 'DOUBLE')}), cuts AS (SELECT variable, list_sort(list_distinct(quantile_cont(v, [{', '.join(repr(i / 10) for i in range(11))}])))[2:-2] AS c FROM long GROUP BY variable),
cells AS (SELECT variable, CAST(len(list_filter(c, lambda e: e < v)) AS VARCHAR) AS k, bad FROM long JOIN cuts USING (variable) WHERE v IS NOT NULL
  UNION ALL SELECT variable, v, bad FROM ({long_sql(['disc', 'tax', *CATEGORIES])}) WHERE v IS NOT NULL),
h AS (SELECT variable, k, sum(bad) AS b, count(*) - sum(bad) AS g FROM cells GROUP BY ALL),
t AS (SELECT *, b / sum(b) OVER (PARTITION BY variable) AS pb, g / sum(g) OVER (PARTITION BY variable) AS pg FROM h),
iv AS (SELECT variable, round(coalesce(sum(CASE WHEN b > 0 AND g > 0 THEN (pb - pg) * ln(pb / pg) END), 0), 6) AS iv FROM t GROUP BY variable)"""


@query(f"{QUICK_SQL} SELECT variable, iv FROM iv")
def iv_quick_all(spark: SparkSession, df: DataFrame) -> DataFrame:
    return profile.quick_iv(df, "bad", FEATURES)


DETECT_SQL = union_all([
    f"""SELECT '{c}' AS variable, '{'numeric' if c in CONTINUOUS else 'categorical'}' AS dtype, count(*) AS count, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS missing,
    round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, round(100.0 * (SELECT max(k) FROM (SELECT count(*) AS k FROM loans WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}), 2) AS one_value_pct,
    {'round(100.0 * sum(CASE WHEN qty = -999 THEN 1 ELSE 0 END) / count(*), 2)' if c == 'qty' else '0.0'} AS special_pct,
    {'round(100.0 * sum(CASE WHEN qty = -999 THEN 1 ELSE 0 END) / count(qty), 2)' if c == 'qty' else 'CAST(NULL AS DOUBLE)'} AS special_pct_valid,
    """ + (f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, max({c}) AS max"
           if c in CONTINUOUS else ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in ("mean", "std", "min", "p25", "p50", "p75", "max"))) + " FROM loans"
    for c in FEATURES
])


@query(DETECT_SQL)
def detect_profile(spark: SparkSession, df: DataFrame) -> DataFrame:
    out = profile.detect(df.select(*FEATURES, "bad"), "bad", {"qty": list(SPECIALS)})
    return out.withColumns({c: F.round(c, 4) for c in ("p25", "p50", "p75")})


@query(union_all([f"SELECT '{c}' AS variable, round(corr({c}, bad), 6) AS target_pearson FROM loans" for c in NUMERIC]))
def target_pearson(spark: SparkSession, df: DataFrame) -> DataFrame:
    return profile.pearson_with_target(df, "bad", NUMERIC)


@query(f"""WITH long AS ({long_sql(['disc', 'tax', *CATEGORIES])}), o AS (SELECT variable, v, bad, count(*) AS o FROM long WHERE v IS NOT NULL GROUP BY ALL),
s AS (SELECT *, sum(o) OVER (PARTITION BY variable, v) AS r, sum(o) OVER (PARTITION BY variable, bad) AS c FROM o)
SELECT variable, round(sqrt(greatest(0, sum(o) * (sum(o * o / (r * c)) - 1)) / (sum(o) * (least(count(DISTINCT v), count(DISTINCT bad)) - 1))), 6) AS target_cramers_v FROM s GROUP BY variable""")
def target_cramers_v(spark: SparkSession, df: DataFrame) -> DataFrame:
    return profile.cramers_v(df, "bad", ["disc", "tax", *CATEGORIES])


@query(union_all([f"SELECT '{c}' AS variable, '{t}' AS dtype, count(*) - count({c}) AS n_missing, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS n_unique FROM loans"
                  for c, t in zip(FEATURES, ["double", "double", "int", "double", "double", "string", "string"], strict=True)]))
def reader_summary(spark: SparkSession, df: DataFrame) -> DataFrame:
    return profile.reader_summary(df.select(*FEATURES, "bad"), ["bad"])


@query("SELECT yr AS period, count(bad) AS n, round(avg(bad), 4) AS bad_rate FROM loans GROUP BY yr")
def target_dist_by_year(spark: SparkSession, df: DataFrame) -> DataFrame:
    return profile.target_by(df, F.col("yr"), "bad")


# Binning


@query(bins_sql(quantile_cuts(8), CONTINUOUS))
def bin_frequency(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, CONTINUOUS, method="frequency", n_bins=8, adjust_shape=False, special_values=SPECIALS)


@query(bins_sql("list_transform(range(1, 6), lambda i: round(min(x) + (max(x) - min(x)) / 6 * i, 12))", CONTINUOUS))
def bin_distance(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, CONTINUOUS, method="distance", n_bins=6, adjust_shape=False, special_values=SPECIALS)


@query(bins_sql(f"{list(QTY_CUTS)}", ["qty"]))
def bin_manual_cutoffs(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, ["qty"], manual_cutoffs=QTY_CUTS, special_values=SPECIALS)


@query(bins_sql(quantile_cuts(4), ["qty"]))
def bin_special_missing(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, ["qty"], method="frequency", n_bins=4, adjust_shape=False, special_values=SPECIALS)


@query(f"""WITH b AS (SELECT CASE WHEN qty IS NULL THEN 6 WHEN qty = -999 THEN 5 ELSE len(list_filter({list(QTY_CUTS)}, lambda e: e < qty)) END AS qty_bin,
  CASE prio WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS prio_bin FROM loans)
SELECT CAST(qty_bin AS INT) AS qty_bin, CAST(prio_bin AS INT) AS prio_bin, count(*) AS n FROM b GROUP BY ALL""")
def bin_transform_index(spark: SparkSession, df: DataFrame) -> DataFrame:
    tables = binning.fit(df, "bad", ["qty", "prio"], Settings(special_values=SPECIALS), {"qty": {"manual_cutoffs": QTY_CUTS}})
    out = binning.transform(df, tables)
    return out.groupBy(F.col("qty").alias("qty_bin"), F.col("prio").alias("prio_bin")).agg(F.count("*").alias("n"))


LEVELS_SQL = f"""WITH long AS ({long_sql(['prio', 'status', 'disc'])}),
h AS (SELECT variable, coalesce(v, '') AS i, CASE WHEN v IS NULL THEN 'missing' ELSE 'main' END AS kind, count(*) AS count, sum(bad) AS count_bad FROM long GROUP BY ALL), {weigh_sql()}"""


@query(LEVELS_SQL)
def bin_categorical_per_value(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, ["prio", "status", "disc"])


@query(f"""WITH c AS (SELECT CAST(disc AS VARCHAR) AS v, count(*) AS k FROM loans GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY k DESC, v) AS i FROM c),
h AS (SELECT 'disc' AS variable, 'main' AS kind, least(i, 4) AS i, count(*) AS count, sum(bad) AS count_bad FROM loans JOIN r ON CAST(disc AS VARCHAR) = v GROUP BY ALL), {weigh_sql()}""")
def bin_freq_merge(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, ["disc"], category_mode="freq_merge", top_n=4)


@query(f"WITH t AS ({bins_sql(quantile_cuts(5), CONTINUOUS)}) SELECT DISTINCT variable, iv_total AS iv FROM t")
def bin_iv_rank(spark: SparkSession, df: DataFrame) -> DataFrame:
    tables = binning.fit(df, "bad", CONTINUOUS, Settings(method="frequency", n_bins=5, adjust_shape=False, special_values=SPECIALS))
    return binning.iv_ranking(spark, tables)


@query()
def bin_chi(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, FEATURES, method="chi", n_bins=5, special_values=SPECIALS)


@query()
def bin_tree(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, NUMERIC, method="tree", n_bins=5, special_values=SPECIALS)


@query()
def bin_trend_adjust_increasing(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, CONTINUOUS, method="frequency", n_bins=10, monotonic="increasing", special_values=SPECIALS)


@query()
def bin_u_shape(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, CONTINUOUS, method="frequency", n_bins=10, monotonic="u", special_values=SPECIALS)


@query()
def bin_badrate_merge(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, ["prio", "disc"], category_mode="badrate_merge")


def missing_merged_sql(order: str) -> str:
    """The bins of qty with the missing rows in the first bin by this order."""
    bins = bins_sql(f"{list(QTY_CUTS)}", ["qty"])
    own = bins[: bins.index("n AS (SELECT *, row_number()")].replace("h AS (SELECT", "h0 AS (SELECT")
    return f"""{own} m AS (SELECT count AS mn, count_bad AS mb FROM h0 WHERE kind = 'missing'),
p AS (SELECT *, row_number() OVER (ORDER BY {order}, kind, i) AS place FROM (SELECT * FROM h0, m WHERE kind <> 'missing')),
h AS (SELECT variable, kind, i, count + CASE WHEN place = 1 THEN mn ELSE 0 END AS count, count_bad + CASE WHEN place = 1 THEN mb ELSE 0 END AS count_bad FROM p),
{weigh_sql()}"""


@query(missing_merged_sql("abs(count_bad / count - mb / mn)"))
def bin_missing_near(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, ["qty"], manual_cutoffs=QTY_CUTS, special_values=SPECIALS, missing_combine="near")


@query(missing_merged_sql("count_bad / count DESC"))
def bin_missing_worst(spark: SparkSession, df: DataFrame) -> DataFrame:
    return table_of(spark, df, ["qty"], manual_cutoffs=QTY_CUTS, special_values=SPECIALS, missing_combine="worst")


@query()
def bin_process_overrides(spark: SparkSession, df: DataFrame) -> DataFrame:
    config = {"qty": {"method": "frequency", "special_values": SPECIALS, "monotonic": "increasing"}, "price": {"method": "distance", "n_bins": 4}, "prio": {"category_mode": "freq_merge", "top_n": 3}}
    return table_of(spark, df, FEATURES, config)


# WOE

QTY_WOE_SQL = f"WITH t AS ({bins_sql(str(list(QTY_CUTS)), ['qty'])})"


@query(f"""{QTY_WOE_SQL} SELECT woe AS qty_woe, CAST(sum(count) AS BIGINT) AS n, CAST(sum(count_bad) AS BIGINT) AS bad FROM t GROUP BY woe""")
def woe_transform_numeric(spark: SparkSession, df: DataFrame) -> DataFrame:
    tables = binning.fit(df, "bad", ["qty"], Settings(manual_cutoffs=QTY_CUTS, special_values=SPECIALS))
    return woe.woe_transform(df, tables).groupBy(F.col("qty").alias("qty_woe")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))


@query(f"WITH t AS ({LEVELS_SQL}) SELECT woe AS prio_woe, CAST(sum(count) AS BIGINT) AS n FROM t WHERE variable = 'prio' GROUP BY woe")
def woe_transform_categorical(spark: SparkSession, df: DataFrame) -> DataFrame:
    return woe.woe_transform(df, binning.fit(df, "bad", ["prio"])).groupBy(F.col("prio").alias("prio_woe")).agg(F.count("*").alias("n"))


def _unseen(strategy: str, pick: str) -> None:
    levels = LEVELS_SQL.replace("FROM loans WHERE true", "FROM loans WHERE prio <> '3-MEDIUM'")
    sql = f"""WITH t AS ({levels}), p AS (SELECT *, row_number() OVER (ORDER BY bin_no) AS o FROM t WHERE variable = 'prio'),
known AS (SELECT DISTINCT prio, dense_rank() OVER (ORDER BY prio) AS o FROM loans WHERE prio <> '3-MEDIUM')
SELECT l.prio, coalesce(p.woe, {pick}) AS prio_woe, count(*) AS n FROM loans l LEFT JOIN known k ON l.prio = k.prio LEFT JOIN p ON p.o = k.o GROUP BY ALL"""

    def f(spark: SparkSession, df: DataFrame) -> DataFrame:
        tables = binning.fit(df.where("prio <> '3-MEDIUM'"), "bad", ["prio"])
        return df.groupBy("prio", woe.woe_column(tables["prio"], F.col("prio"), strategy).alias("prio_woe")).agg(F.count("*").alias("n"))

    f.__name__ = f"woe_unseen_{strategy}"
    query(sql)(f)


_unseen("worst", "(SELECT arg_max(woe, bad_rate) FROM p)")
_unseen("most_common", "(SELECT arg_max(woe, count) FROM p)")
_unseen("missing", "CAST(0 AS DOUBLE)")
_unseen("zero", "CAST(0 AS DOUBLE)")


# Drift

PSI_SUM = "round(sum((a - e) * ln(a / e)), 6)"


def psi_sql(cells: str, keys: str) -> str:
    """cells: a query with keys, expected, actual."""
    return f"""s AS (SELECT *, least(1, greatest(1e-6, expected / sum(expected) OVER (PARTITION BY {keys}))) AS e, least(1, greatest(1e-6, actual / sum(actual) OVER (PARTITION BY {keys}))) AS a FROM ({cells}))"""


@query(f"""WITH long AS ({long_sql(CONTINUOUS, 'DOUBLE')}), q AS (SELECT variable, list_sort(list_distinct(quantile_cont(v, [{', '.join(repr(i / 10) for i in range(11))}]))) AS c FROM long WHERE yr <= 1998 GROUP BY variable),
b AS (SELECT variable, yr, CASE WHEN v BETWEEN c[1] AND c[-1] THEN len(list_filter(c[2:-2], lambda x: x < v)) ELSE -1 END AS k FROM long JOIN q USING (variable) WHERE v IS NOT NULL AND (yr <= 1998 OR yr >= 2000)),
{psi_sql("SELECT variable, k, count(*) FILTER (yr <= 1998) AS expected, count(*) FILTER (yr >= 2000) AS actual FROM b GROUP BY ALL", "variable")} SELECT variable, {PSI_SUM} AS psi FROM s GROUP BY variable""")
def psi_numeric(spark: SparkSession, df: DataFrame) -> DataFrame:
    train, _, oot = samples(df)
    return drift.psi_table(train, oot, CONTINUOUS)


@query(f"""WITH b AS (SELECT CASE WHEN disc <= 8 THEN CAST(disc AS VARCHAR) ELSE 'unseen' END AS k, yr, disc FROM loans),
{psi_sql("SELECT 'disc' AS variable, k, count(*) FILTER (yr <= 1998 AND disc <= 8) AS expected, count(*) FILTER (yr >= 2000) AS actual FROM b GROUP BY ALL", "variable")} SELECT variable, {PSI_SUM} AS psi FROM s GROUP BY variable""")
def psi_categorical_unseen(spark: SparkSession, df: DataFrame) -> DataFrame:
    train, _, oot = samples(df)
    return drift.psi_table(train.where("disc <= 8"), oot, ["disc"])


STABLE_SQL = f"""WITH long AS ({long_sql(['price', 'total'], 'DOUBLE')}), q AS (SELECT variable, list_sort(list_distinct(quantile_cont(v, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS c FROM long WHERE yr = 1995 GROUP BY variable),
k AS (SELECT variable, yr, CAST(len(list_filter(c[2:-2], lambda x: x < v)) AS VARCHAR) AS b FROM long JOIN q USING (variable) WHERE v BETWEEN c[1] AND c[-1]
  UNION ALL SELECT variable, yr, v FROM ({long_sql(['prio'])}) WHERE v IS NOT NULL),
h AS (SELECT variable, yr, b, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT variable, b FROM h) JOIN (SELECT DISTINCT variable, yr FROM h) USING (variable)),
d AS (SELECT variable, yr, b, coalesce(n, 0) AS actual FROM g LEFT JOIN h USING (variable, yr, b)),
w AS (SELECT *, first(actual) OVER (PARTITION BY variable, b ORDER BY yr) AS first, lag(actual) OVER (PARTITION BY variable, b ORDER BY yr) AS prev FROM d),
p1 AS (SELECT *, least(1, greatest(1e-6, first / sum(first) OVER (PARTITION BY variable, yr))) AS e, least(1, greatest(1e-6, actual / sum(actual) OVER (PARTITION BY variable, yr))) AS a FROM w),
p2 AS (SELECT *, least(1, greatest(1e-6, prev / sum(prev) OVER (PARTITION BY variable, yr))) AS e, least(1, greatest(1e-6, actual / sum(actual) OVER (PARTITION BY variable, yr))) AS a FROM w WHERE prev IS NOT NULL),
f1 AS (SELECT variable, yr, {PSI_SUM} AS psi_vs_first FROM p1 GROUP BY ALL), f2 AS (SELECT variable, yr, {PSI_SUM} AS psi_vs_prev FROM p2 GROUP BY ALL),
m AS (SELECT variable, yr, count(bad) AS n, round(sum(bad) / count(bad), 4) AS bad_rate, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM long GROUP BY ALL
  UNION ALL SELECT 'prio', yr, count(bad), round(sum(bad) / count(bad), 4), NULL, NULL FROM loans GROUP BY ALL),
r AS (SELECT *, round((bad_rate - first(bad_rate) OVER (PARTITION BY variable ORDER BY yr)) / first(bad_rate) OVER (PARTITION BY variable ORDER BY yr), 4) AS change FROM m),
t AS (SELECT variable, yr AS time_period, n, bad_rate, CASE WHEN yr > 1995 THEN change END AS bad_rate_change, CASE WHEN yr > 1995 THEN psi_vs_first END AS psi_vs_first, psi_vs_prev, mean, std,
  CASE WHEN yr = 1995 THEN 'baseline' WHEN psi_vs_first > 0.1 THEN 'unstable' ELSE 'stable' END AS psi_flag,
  CASE WHEN yr = 1995 THEN 'baseline' WHEN change > 0.5 THEN 'trending_up' WHEN change < -0.5 THEN 'trending_down' ELSE 'stable' END AS bad_rate_flag
  FROM r LEFT JOIN f1 USING (variable, yr) LEFT JOIN f2 USING (variable, yr))"""


@query(f"{STABLE_SQL} SELECT * FROM t")
def stability_by_year(spark: SparkSession, df: DataFrame) -> DataFrame:
    return drift.stability(df, "bad", F.col("yr"), ["price", "total", "prio"])


YEARS = list(range(1995, 2002))


@query(f"""{STABLE_SQL} SELECT variable, {', '.join(f'max(bad_rate) FILTER (time_period = {y}) AS "{y}"' for y in YEARS)},
  arg_max(psi_flag, time_period) AS psi_flag, arg_max(bad_rate_flag, time_period) AS bad_rate_flag FROM t GROUP BY variable""")
def stability_summary_pivot(spark: SparkSession, df: DataFrame) -> DataFrame:
    return drift.stability_summary(drift.stability(df, "bad", F.col("yr"), ["price", "total", "prio"]), YEARS)


# Dependence

PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]


@query(union_all([f"SELECT '{a}' AS var1, '{b}' AS var2, round(abs(corr({a}, {b})), 4) AS corr FROM loans" for a, b in PAIRS]))
def correlation_pearson(spark: SparkSession, df: DataFrame) -> DataFrame:
    return drift.correlations(df, NUMERIC, threshold=0.0)


SMALL = ["qty", "disc", "tax"]
SMALL_PAIRS = [(a, b) for i, a in enumerate(SMALL) for b in SMALL[i + 1 :]]


@query(union_all([f"""SELECT '{a}' AS var1, '{b}' AS var2, round(abs(corr(ra, rb)), 4) AS corr FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra,
  rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM loans WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a, b in SMALL_PAIRS]))
def correlation_spearman(spark: SparkSession, df: DataFrame) -> DataFrame:
    return drift.correlations(df, SMALL, threshold=0.0, method="spearman")


def kendall_sql() -> str:
    cells, parts = [], []
    for i, (a, b) in enumerate(SMALL_PAIRS):
        cells.append(f"c{i} AS (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, count(*) AS n FROM loans WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)")
        signs = f"(SELECT sum(CAST(p.n AS DOUBLE) * q.n * sign(q.y - p.y)) FROM c{i} p JOIN c{i} q ON p.x < q.x)"
        tied = lambda side: f"(SELECT sum(CAST(m AS DOUBLE) * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c{i} GROUP BY {side}))"  # noqa: B023, E731
        parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, round(abs({signs} / sqrt((t - {tied('x')}) * (t - {tied('y')}))), 4) AS corr FROM (SELECT CAST(sum(n) AS DOUBLE) * (sum(n) - 1) / 2 AS t FROM c{i})")
    return f"WITH {', '.join(cells)} {union_all(parts)}"


@query(kendall_sql())
def correlation_kendall(spark: SparkSession, df: DataFrame) -> DataFrame:
    return drift.correlations(df, SMALL, threshold=0.0, method="kendall")


@query("""WITH c AS (SELECT * FROM loans WHERE qty IS NOT NULL AND tax IS NOT NULL), r AS (SELECT corr(qty, disc) AS a, corr(qty, tax) AS b, corr(disc, tax) AS c FROM c),
d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r),
v AS (SELECT unnest(['qty', 'disc', 'tax']) AS variable, unnest([(1 - c * c) / det, (1 - b * b) / det, (1 - a * a) / det]) AS v FROM d)
SELECT variable, round(v, 4) AS vif, CASE WHEN v > 10 THEN 'high' ELSE 'ok' END AS flag FROM v""")
def vif_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    return drift.vif(df, SMALL)


# Screening


def _support(spark: SparkSession, found: screening.Screen) -> DataFrame:
    return spark.createDataFrame([(c, c in found.support, ";".join(found.reasons[c])) for c in found.reasons], "feature string, selected boolean, reason string")


def verdicts(rows: list[tuple[str, str]], reason: str) -> str:
    """rows: (feature, condition on loans that drops it)."""
    return union_all([f"SELECT '{c}' AS feature, NOT ({test}) AS selected, CASE WHEN {test} THEN '{reason}' ELSE '' END AS reason FROM loans" for c, test in rows])


@query(verdicts([(c, f"1 - count({c}) / count(*) > 0.02") for c in FEATURES], "missing"))
def filter_missing(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _support(spark, screening.screen(df, "bad", FEATURES, max_missing_rate=0.02, iv_range=(None, None), max_corr=None))


@query(verdicts([(c, f"(SELECT max(k) FROM (SELECT count(*) AS k FROM loans WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}) > 0.15") for c in FEATURES], "one_value"))
def filter_one_value(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _support(spark, screening.screen(df, "bad", FEATURES, max_one_value_rate=0.15, iv_range=(None, None), max_corr=None))


@query(f"{QUICK_SQL} SELECT variable AS feature, NOT (iv < 0.02) AS selected, CASE WHEN iv < 0.02 THEN 'iv' ELSE '' END AS reason FROM iv")
def filter_iv(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _support(spark, screening.screen(df, "bad", FEATURES, max_corr=None))


AUC_SQL = union_all([f"""SELECT '{c}' AS variable, {'CAST(0.5 AS DOUBLE)' if c in ('qty', 'tax') else f'(SELECT sum(b * (u - g / 2)) / (sum(b) * sum(g)) FROM (SELECT *, sum(g) OVER (ORDER BY {c}) AS u FROM (SELECT {c}, sum(bad) AS b, count(*) - sum(bad) AS g FROM loans GROUP BY {c})))'} AS auc""" for c in NUMERIC])


@query(f"WITH a AS ({AUC_SQL}) SELECT variable AS feature, NOT (auc < 0.52) AS selected, CASE WHEN auc < 0.52 THEN 'auc' ELSE '' END AS reason FROM a")
def filter_auc(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _support(spark, screening.screen(df, "bad", NUMERIC, min_auc=0.52, iv_range=(None, None), max_corr=None))


@query(f"""WITH long AS ({long_sql(['price', 'total'], 'DOUBLE')}), q AS (SELECT variable, list_sort(list_distinct(quantile_cont(v, [{', '.join(repr(i / 10) for i in range(11))}])))[2:-2] AS c FROM long WHERE yr <= 1998 GROUP BY variable),
cut AS (SELECT variable, list_sort(list_distinct(list(m))) AS c FROM (SELECT variable, len(list_filter(c, lambda x: x < v)) AS i, max(v) AS m, any_value(len(c)) AS n FROM long JOIN q USING (variable) WHERE yr <= 1998 GROUP BY ALL) WHERE i < n GROUP BY variable),
b AS (SELECT variable, yr, len(list_filter(c, lambda x: x <= v)) AS k FROM long JOIN cut USING (variable) WHERE v IS NOT NULL AND (yr <= 1998 OR yr >= 2000)),
{psi_sql("SELECT variable, k, count(*) FILTER (yr <= 1998) AS expected, count(*) FILTER (yr >= 2000) AS actual FROM b GROUP BY ALL", "variable")} SELECT variable AS feature, {PSI_SUM} AS psi FROM s GROUP BY variable""")
def filter_psi(spark: SparkSession, df: DataFrame) -> DataFrame:
    train, _, oot = samples(df)
    found = screening.screen(train, "bad", ["price", "total"], test=oot, max_psi=0.1, iv_range=(None, None), max_corr=None)
    return spark.createDataFrame(sorted(found.measures["psi"].items()), "feature string, psi double")


@query(f"""{QUICK_SQL}, c AS (SELECT CASE WHEN (SELECT iv FROM iv WHERE variable = 'qty') < (SELECT iv FROM iv WHERE variable = 'price') THEN 'qty' ELSE 'price' END AS loser FROM loans HAVING round(abs(corr(qty, price)), 4) > 0.0001 LIMIT 1)
SELECT variable AS feature, variable NOT IN (SELECT loser FROM c) AS selected, CASE WHEN variable IN (SELECT loser FROM c) THEN 'corr' ELSE '' END AS reason FROM iv WHERE variable IN ('qty', 'price')""")
def filter_corr(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _support(spark, screening.screen(df, "bad", ["qty", "price"], iv_range=(None, None), max_corr=0.0001))


@query()
def filter_vif(spark: SparkSession, df: DataFrame) -> DataFrame:
    twin = df.withColumn("price_twin", F.col("price") + F.col("disc") / 100)
    return _support(spark, screening.screen(twin, "bad", ["price", "price_twin", "disc", "total"], iv_range=(None, None), max_corr=None, max_vif=10.0))


@query(f"""{QUICK_SQL} SELECT variable AS feature, round(CASE variable {' '.join(f"WHEN '{c}' THEN (SELECT 1 - count({c}) / count(*) FROM loans)" for c in FEATURES)} END, 6) AS missing_rate,
  round(CASE variable {' '.join(f"WHEN '{c}' THEN (SELECT max(k) / sum(k) FROM (SELECT count(*) AS k FROM loans WHERE {c} IS NOT NULL GROUP BY {c}))" for c in FEATURES)} END, 6) AS one_value_rate,
  iv, 'equalfreq' AS iv_source, NOT (iv < 0.02) AS selected, iv < 0.02 AS dropped, CASE WHEN iv < 0.02 THEN 'iv' ELSE '' END AS reason FROM iv""")
def filter_quality_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    return screening.screen(df, "bad", FEATURES, max_corr=None).quality


@query(f"{QUICK_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY iv DESC, variable) AS k FROM iv) SELECT variable AS feature, k <= 3 AS selected, CASE WHEN k > 3 THEN 'top_n' ELSE '' END AS reason FROM r")
def filter_topn(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _support(spark, screening.screen(df, "bad", FEATURES, iv_range=(None, None), max_corr=None, n_selected=3))


# Metrics: a probability by a fixed formula

PROBABILITY_SQL = "round(1 / (1 + exp(-(-6.0 + 0.35 * disc + 20.0 * coalesce(tax, 0.04) + 0.03 * CASE WHEN qty IS NULL OR qty = -999 THEN 25.0 ELSE qty END))), 4)"


def scored(df: DataFrame) -> DataFrame:
    quantity = F.when(F.col("qty").isNull() | (F.col("qty") == -999), 25.0).otherwise(F.col("qty"))
    p = F.round(1 / (1 + F.exp(-(F.lit(-6.0) + F.lit(0.35) * F.col("disc") + F.lit(20.0) * F.coalesce("tax", F.lit(0.04)) + F.lit(0.03) * quantity))), 4)
    split = F.when(F.col("yr") <= 1998, "train").when(F.col("yr") == 1999, "test").otherwise("oot")
    return df.withColumns({"p": p, "split": split})


SCORED_SQL = f"WITH scored AS (SELECT *, CAST({PROBABILITY_SQL} AS DOUBLE) AS p, CASE WHEN yr <= 1998 THEN 'train' WHEN yr = 1999 THEN 'test' ELSE 'oot' END AS split FROM loans)"


def ks_sql(key: str, name: str = "k") -> str:
    return f"""{name}0 AS (SELECT {key}, p, sum(bad) AS b, count(*) - sum(bad) AS g FROM scored GROUP BY ALL),
{name}1 AS (SELECT *, sum(b) OVER (PARTITION BY {key} ORDER BY p) AS cb, sum(g) OVER (PARTITION BY {key} ORDER BY p) AS cg, sum(b) OVER (PARTITION BY {key}) AS tb, sum(g) OVER (PARTITION BY {key}) AS tg FROM {name}0),
{name} AS (SELECT {key}, CAST(sum(b + g) AS BIGINT) AS n, round(sum(b) / sum(b + g), 6) AS bad_rate, round(max(abs(cb / tb - cg / tg)), 6) AS ks, round(sum(b * (cg - g / 2) / (tb * tg)), 6) AS auc FROM {name}1 GROUP BY {key})"""


CUTS_SQL = f"cut AS (SELECT list_sort(list_distinct(quantile_cont(p, [{', '.join(repr(i / 10) for i in range(11))}])))[2:-2] AS c FROM scored WHERE split = 'train')"


@query(f"{SCORED_SQL}, {ks_sql('split')} SELECT * FROM k")
def auc_ks_by_split(spark: SparkSession, df: DataFrame) -> DataFrame:
    return metrics.ks_auc(scored(df), F.col("p"), "bad", ["split"])


@query(f"{SCORED_SQL}, {ks_sql('split')} SELECT split, round(max(cb / tb - cg / tg), 6) AS ks FROM k1 GROUP BY split")
def ks_signed_by_split(spark: SparkSession, df: DataFrame) -> DataFrame:
    return metrics.signed_ks(scored(df), F.col("p"), "bad", ["split"])


@query(f"""{SCORED_SQL}, {CUTS_SQL}, h AS (SELECT len(list_filter(c, lambda x: x < p)) AS bin, count(*) AS count, count(*) - sum(bad) AS good, sum(bad) AS bad FROM scored, cut GROUP BY ALL)
SELECT CAST(bin AS INT) AS bin, count, CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad, round(bad / count, 4) AS bad_rate, round(100.0 * count / sum(count) OVER (), 2) AS pct, round(100.0 * sum(good) OVER w / sum(good) OVER (), 2) AS cum_good_pct,
  round(100.0 * sum(bad) OVER w / sum(bad) OVER (), 2) AS cum_bad_pct, round(abs(100.0 * sum(good) OVER w / sum(good) OVER () - 100.0 * sum(bad) OVER w / sum(bad) OVER ()), 2) AS ks FROM h WINDOW w AS (ORDER BY bin)""")
def score_distribution_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    own = scored(df)
    return metrics.score_table(own, "p", "bad", metrics.score_edges(own.where("split = 'train'"), "p"))


def score_psi_sql(key: str) -> str:
    return f"""b AS (SELECT *, len(list_filter(c, lambda x: x < p)) AS bin FROM scored, cut), e0 AS (SELECT bin, count(*) AS expected FROM b WHERE split = 'train' GROUP BY bin), a0 AS (SELECT {key}, bin, count(*) AS actual FROM b GROUP BY ALL),
{psi_sql(f"SELECT {key}, bin, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM (SELECT DISTINCT {key} FROM a0) CROSS JOIN (SELECT DISTINCT bin FROM b) LEFT JOIN e0 USING (bin) LEFT JOIN a0 USING ({key}, bin)", key)}"""


@query(f"{SCORED_SQL}, {CUTS_SQL}, {score_psi_sql('split')} SELECT split, {PSI_SUM} AS psi_score FROM s GROUP BY split")
def score_psi(spark: SparkSession, df: DataFrame) -> DataFrame:
    own = scored(df)
    return metrics.score_psi(own, "p", metrics.score_edges(own.where("split = 'train'"), "p"), ["split"], F.col("split") == "train")


@query(f"""{SCORED_SQL}, {CUTS_SQL}, {ks_sql('split')}, {ks_sql('yr', 'y')}, {score_psi_sql('yr')}, acc AS (SELECT yr, round(avg(CASE WHEN CAST(p >= 0.2 AS INT) = bad THEN 1.0 ELSE 0.0 END), 6) AS acc FROM scored GROUP BY yr),
base AS (SELECT ks AS bk, auc AS ba FROM k WHERE split = 'train'), ps AS (SELECT yr, {PSI_SUM} AS psi_score FROM s GROUP BY yr)
SELECT yr AS period, n, bad_rate, ks, auc, acc, psi_score, round((bk - ks) / bk, 6) AS ks_decay, round((ba - auc) / ba, 6) AS auc_decay FROM y JOIN acc USING (yr) JOIN ps USING (yr), base""")
def evaluate_by_year(spark: SparkSession, df: DataFrame) -> DataFrame:
    own = scored(df)
    train = own.where("split = 'train'")
    base = metrics.ks_auc(train, F.col("p"), "bad", []).first()
    return metrics.by_period(own, "p", "bad", F.col("yr"), metrics.score_edges(train, "p"), F.col("split") == "train", base.ks, base.auc, 0.2)


@query(f"{SCORED_SQL} SELECT split, round(avg(CASE WHEN CAST(p >= 0.3 AS INT) = bad THEN 1.0 ELSE 0.0 END), 6) AS acc FROM scored GROUP BY split")
def accuracy_at_threshold(spark: SparkSession, df: DataFrame) -> DataFrame:
    return metrics.accuracy(scored(df), F.col("p"), "bad", ["split"], 0.3)


@query(f"""{SCORED_SQL}, h AS (SELECT p AS score, sum(bad) AS b, count(*) - sum(bad) AS g FROM scored GROUP BY p)
SELECT score, round(sum(g) OVER w / sum(g) OVER (), 6) AS fpr, round(sum(b) OVER w / sum(b) OVER (), 6) AS tpr FROM h WINDOW w AS (ORDER BY score DESC)""")
def roc_points(spark: SparkSession, df: DataFrame) -> DataFrame:
    return metrics.roc_points(scored(df), F.col("p"), "bad")


@query(f"""{SCORED_SQL}, h AS (SELECT p AS score, sum(bad) AS b, count(*) - sum(bad) AS g FROM scored GROUP BY p), c AS (SELECT score, sum(g) OVER w / sum(g) OVER () AS cg, sum(b) OVER w / sum(b) OVER () AS cb FROM h WINDOW w AS (ORDER BY score))
SELECT score, round(cg, 6) AS cum_good, round(cb, 6) AS cum_bad, round(abs(cb - cg), 6) AS gap FROM c""")
def ks_curve_points(spark: SparkSession, df: DataFrame) -> DataFrame:
    return metrics.ks_curve(scored(df), F.col("p"), "bad")


@query(f"""{SCORED_SQL}, e AS (SELECT min(p) AS lo, (max(p) - min(p)) / 20 AS w FROM scored) SELECT split, CAST(least(floor((p - lo) / w), 19) AS INT) AS bin, count(*) AS n FROM scored, e GROUP BY ALL""")
def score_histogram(spark: SparkSession, df: DataFrame) -> DataFrame:
    return metrics.histogram(scored(df), "p", ["split"])


# Models


def _woe_sample(df: DataFrame) -> tuple[dict[str, binning.BinTable], DataFrame]:
    tables = binning.fit(df, "bad", SMALL, Settings(special_values=SPECIALS), {"qty": {"manual_cutoffs": QTY_CUTS}})
    return tables, woe.woe_transform(df.select(*SMALL, "bad", "yr"), tables)


@query()
def logit_coefficients(spark: SparkSession, df: DataFrame) -> DataFrame:
    model = scorecard.fit_model(_woe_sample(df)[1], "bad", SMALL)
    rows = [("const", round(model.intercept, 6), None), *((c, round(v, 6), round(model.p_values[c], 6)) for c, v in model.coef.items())]
    return spark.createDataFrame(rows, "variable string, coef double, p_value double")


@query()
def scorecard_points(spark: SparkSession, df: DataFrame) -> DataFrame:
    tables, encoded = _woe_sample(df)
    return scorecard.ScoreCard(scorecard.fit_model(encoded, "bad", SMALL), tables).points(spark).drop("coef")


@query()
def scorecard_predict(spark: SparkSession, df: DataFrame) -> DataFrame:
    tables, encoded = _woe_sample(df)
    card = scorecard.ScoreCard(scorecard.fit_model(encoded, "bad", SMALL), tables)
    return df.groupBy(F.round(card.score(), 2).alias("score")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))


@query()
def quality_single_var(spark: SparkSession, df: DataFrame) -> DataFrame:
    with kept(df.select(*FEATURES, "yr", "bad")) as df:
        train, _, oot = samples(df)
        return quality(train, "bad", FEATURES, test=oot)


@query()
def stepwise_forward(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(_stepwise(df).support)], "position int, feature string")


@query()
def stepwise_record(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _stepwise(df).record_frame(spark)


def _stepwise(df: DataFrame) -> scorecard.Stepwise:
    with kept(df.where("yr <= 1999").select(*FEATURES, "yr", "bad")) as df:
        train, test, _ = samples(df)
        tables = binning.fit(train, "bad", FEATURES, Settings(n_bins=5, special_values=SPECIALS))
        columns = [c for c in FEATURES if c in tables]
        encode = lambda d: woe.woe_transform(d.select(*columns, "bad"), tables)
        settings = scorecard.StepwiseSettings(n_min=2, n_max=5, random_state=1)
        return scorecard.stepwise(encode(train), "bad", columns, encode(test), settings)


# Rules


AND = " || ' AND ' || "


def rules_sql(depth: int, lift: float, low: float, high: float) -> str:
    names = sorted(RULE_CUTS)
    bins = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN len(list_filter({RULE_CUTS[c]}, lambda x: x < {c})) END AS {c}" for c in names)

    def text(c: str) -> str:
        cuts, out = RULE_CUTS[c], []
        for i in range(len(cuts) + 1):
            out.append(f"WHEN {i} THEN '{rules.Part(c, ([-INF, *cuts])[i], ([*cuts, INF])[i]).text()}'")
        return f"CASE {c} {' '.join(out)} END"

    sets = [s for k in range(1, depth + 1) for s in combinations(names, k)]
    parts = [f"SELECT {AND.join(text(c) for c in s)} AS rule, count(*) AS hit, sum(bad) AS bad FROM b WHERE {' AND '.join(f'{c} IS NOT NULL' for c in s)} GROUP BY ALL" for s in sets]
    missing = [f"SELECT '{c} is missing' AS rule, count(*) AS hit, sum(bad) AS bad FROM b WHERE {c} IS NULL" for c in names]
    return f"""WITH b AS (SELECT {bins}, bad FROM loans), a AS ({union_all(parts + missing)}), t AS (SELECT count(*) AS n, sum(bad) AS nb FROM loans)
SELECT rule, hit AS hit_count, CAST(bad AS BIGINT) AS bad_count, CAST(hit - bad AS BIGINT) AS good_count, round(hit / n, 6) AS hit_rate, round(bad / hit, 6) AS precision, round(bad / nb, 6) AS recall, round((bad / hit) / (nb / n), 4) AS lift
FROM a, t WHERE hit > 0 AND hit / n BETWEEN {low} AND {high} AND round((bad / hit) / (nb / n), 4) >= {lift}"""


def _rules(df: DataFrame, **settings: object) -> tuple[list[rules.Rule], int, int]:
    tables = {c: binning.BinTable(c, "numeric", "manual", [], cuts) for c, cuts in RULE_CUTS.items()}
    n, bad = df.agg(F.count("*"), F.sum("bad")).first()
    return rules.mine(df, "bad", sorted(RULE_CUTS), rules.RuleSettings(**settings), tables), n, bad


def _rule_rows(spark: SparkSession, df: DataFrame, **settings: object) -> DataFrame:
    return rules.rules_table(spark, *_rules(df, **settings)).drop("single_hit_count", "single_hit_rate")


@query(rules_sql(1, 1.2, 0.01, 0.5))
def rules_depth1(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _rule_rows(spark, df, max_depth=1, min_lift=1.2, max_hit_rate=0.5, max_rules=1000)


@query(rules_sql(2, 1.5, 0.01, 0.2))
def rules_depth2(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _rule_rows(spark, df, max_depth=2, min_lift=1.5, max_rules=1000)


@query(rules_sql(3, 2.0, 0.01, 0.2))
def rules_depth3(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _rule_rows(spark, df, max_depth=3, min_lift=2.0, max_rules=1000)


@query(f"WITH r AS ({rules_sql(1, 0.5, 0.001, 0.5)}) SELECT * FROM r WHERE rule LIKE '%missing'")
def rules_missing(spark: SparkSession, df: DataFrame) -> DataFrame:
    out = _rule_rows(spark, df, max_depth=1, min_lift=0.5, min_hit_rate=0.001, max_hit_rate=0.5, max_rules=1000)
    return out.where(F.col("rule").endswith("missing"))


@query()
def rules_apriori(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _rule_rows(spark, df, method="apriori", min_lift=1.2, max_hit_rate=0.5)


@query()
def rules_tree(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _rule_rows(spark, df, method="tree", min_lift=1.2, max_hit_rate=0.5)


TOP_RULES = [("disc > 8.00", "disc > 8"), ("tax > 0.06", "tax > 0.06"), ("qty > 40.00", "qty > 40"), ("qty is missing", "qty IS NULL")]


def _top_rules() -> list[rules.Rule]:
    P = rules.Part
    return [rules.Rule((p,), 0, 0) for p in (P("disc", 8.0), P("tax", 0.06), P("qty", 40.0), P("qty", missing=True))]


@query(f"""WITH h AS (SELECT {', '.join(f'CAST(coalesce({test}, false) AS INT) AS r{i}' for i, (_, test) in enumerate(TOP_RULES))} FROM loans), s AS (SELECT *, {' + '.join(f'r{i}' for i in range(len(TOP_RULES)))} AS k FROM h)
{union_all([f"SELECT '{name}' AS rule, CAST(sum(r{i}) AS BIGINT) AS hit_count, CAST(sum(CASE WHEN k = 1 THEN r{i} ELSE 0 END) AS BIGINT) AS single_hit_count FROM s" for i, (name, _) in enumerate(TOP_RULES)])}""")
def rules_single_hit(spark: SparkSession, df: DataFrame) -> DataFrame:
    found = rules.single_hits(df, rules.measured(df, "bad", _top_rules()))
    return spark.createDataFrame([(r.text, r.hit, r.single) for r in found], "rule string, hit_count long, single_hit_count long")


@query(f"""WITH h AS (SELECT CASE {' '.join(f'WHEN {test} THEN {i}' for i, (_, test) in enumerate(TOP_RULES))} END AS k, bad FROM loans), c AS (SELECT k, count(*) AS n, sum(bad) AS b FROM h WHERE k IS NOT NULL GROUP BY k),
w AS (SELECT k, sum(n) OVER (ORDER BY k) AS cn, sum(b) OVER (ORDER BY k) AS cb FROM c)
SELECT CASE k {' '.join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(TOP_RULES))} END AS rule, CAST(cn AS BIGINT) AS cum_hit, round(cb / (SELECT sum(bad) FROM loans), 6) AS cum_recall, round(cb / cn, 6) AS cum_bad_rate FROM w""")
def rules_coverage(spark: SparkSession, df: DataFrame) -> DataFrame:
    return rules.coverage(df, "bad", _top_rules())


# Monitoring, diagnosis, splits


def _watched(df: DataFrame) -> DataFrame:
    return scored(df).withColumn("score", F.round(600 - 100 * F.col("p"), 2))


MONITOR_SQL = """WITH scored AS (SELECT *, CAST(round(600 - 100 * {p}, 2) AS DOUBLE) AS s FROM (SELECT *, CAST({p0} AS DOUBLE) AS p FROM loans)), base AS (SELECT min(s) AS lo, max(s) AS hi, (max(s) - min(s)) / 20 AS w FROM scored WHERE yr <= 1998),
b AS (SELECT yr, CASE WHEN s BETWEEN lo AND hi THEN least(floor((s - lo) / w), 19) END AS bin FROM scored, base), e0 AS (SELECT bin, count(*) AS expected FROM b WHERE yr <= 1998 AND bin IS NOT NULL GROUP BY bin), a0 AS (SELECT yr, bin, count(*) AS actual FROM b WHERE yr >= 1999 AND bin IS NOT NULL GROUP BY ALL),
""".replace("{p}", "p").replace("{p0}", PROBABILITY_SQL)


@query(MONITOR_SQL + psi_sql("SELECT yr, bin, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM (SELECT DISTINCT yr FROM a0) CROSS JOIN (SELECT DISTINCT bin FROM b WHERE bin IS NOT NULL) LEFT JOIN e0 USING (bin) LEFT JOIN a0 USING (yr, bin)", "yr")
       + f" SELECT CAST(yr AS VARCHAR) AS period, {PSI_SUM} AS psi_score FROM s GROUP BY yr")
def monitor_score_psi(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _tracked(df).history(spark).select("period", "psi_score")


def _tracked(df: DataFrame) -> monitoring.Monitor:
    with kept(_watched(df).select("yr", "bad", "score", "qty")) as own:
        train = own.where("yr <= 1998")
        tables = binning.fit(train, "bad", ["qty"], Settings(manual_cutoffs=QTY_CUTS, special_values=SPECIALS))
        out = monitoring.baseline(train, "score", "bad", tables)
        for year in (1999, 2000, 2001):
            out.track(own.where(F.col("yr") == year), str(year), "score", "bad")
        return out


@query(f"""WITH b AS (SELECT yr, CASE WHEN qty IS NULL THEN 6 WHEN qty = -999 THEN 5 ELSE len(list_filter({list(QTY_CUTS)}, lambda e: e < qty)) END AS bin FROM loans), e0 AS (SELECT bin, count(*) AS expected FROM b WHERE yr <= 1998 GROUP BY bin), a0 AS (SELECT yr, bin, count(*) AS actual FROM b WHERE yr >= 1999 GROUP BY ALL),
{psi_sql("SELECT yr, bin, expected, coalesce(actual, 0) AS actual FROM (SELECT DISTINCT yr FROM a0) CROSS JOIN e0 LEFT JOIN a0 USING (yr, bin)", "yr")} SELECT CAST(yr AS VARCHAR) AS period, 'qty' AS feature, {PSI_SUM} AS psi FROM s GROUP BY yr""")
def monitor_feature_psi(spark: SparkSession, df: DataFrame) -> DataFrame:
    rows = [(s.period, c, v) for s in _tracked(df).snapshots for c, v in s.psi_features.items()]
    return spark.createDataFrame(rows, "period string, feature string, psi double")


@query(f"""{SCORED_SQL.replace('ELSE ' + repr('oot') + ' END AS split', 'ELSE CAST(yr AS VARCHAR) END AS split').replace("WHEN yr = 1999 THEN 'test' ", '')}, {ks_sql('split')} SELECT split AS period, ks, round((b.ks0 - ks) / b.ks0, 6) AS ks_decay FROM k, (SELECT ks AS ks0 FROM k WHERE split = 'train') b WHERE split <> 'train'""")
def monitor_ks_decay(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([(s.period, s.ks, s.ks_decay) for s in _tracked(df).snapshots], "period string, ks double, ks_decay double")


@query()
def monitor_alerts(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _tracked(df).history(spark).drop("timestamp")


@query()
def diagnose_issues(spark: SparkSession, df: DataFrame) -> DataFrame:
    with kept(df.select(*FEATURES, "yr", "bad")) as df:
        own = scored(df)
        found = {r.split: r for r in metrics.ks_auc(own, F.col("p"), "bad", ["split"]).collect()}
        psi = dict(metrics.score_psi(own, "p", metrics.score_edges(own.where("split = 'train'"), "p"), ["split"], F.col("split") == "train").collect())
        result = {"trn_ks": found["train"].ks, "test_ks": found["test"].ks, "oot_ks": found["oot"].ks, "trn_auc": found["train"].auc, "test_auc": found["test"].auc, "psi": psi["test"], "psi_oot": psi["oot"], "n_vars": 3}
        tables = binning.fit(df, "bad", FEATURES, Settings(special_values=SPECIALS))
        return diagnosis.diagnose(result, tables=tables, bad_rate=0.1).frame(spark).withColumn("culprit_vars", F.array_join("culprit_vars", ","))


@query("""SELECT 'dev' AS part, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM loans WHERE apply_date >= TIMESTAMP '1996-01-01' AND apply_date <= TIMESTAMP '1998-12-31'
UNION ALL SELECT 'oot', count(*), CAST(sum(bad) AS BIGINT) FROM loans WHERE apply_date >= TIMESTAMP '1998-07-01'""")
def split_time(spark: SparkSession, df: DataFrame) -> DataFrame:
    dev, oot = splitting.split_time(df, "apply_date", ("1996-01-01", "1998-12-31"), ("1998-07-01", None))
    counts = lambda d, name: d.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("bad").alias("bad"))
    return counts(dev, "dev").union(counts(oot, "oot"))


@query("""WITH c AS (SELECT bad, count(*) AS k, greatest(1, least(ceil(count(*) * 0.7), count(*) - 1)) AS w FROM loans GROUP BY bad)
SELECT bad, 'train' AS split, CAST(w AS BIGINT) AS n FROM c UNION ALL SELECT bad, 'test', CAST(k - w AS BIGINT) FROM c""")
def split_stratified(spark: SparkSession, df: DataFrame) -> DataFrame:
    out = splitting.split_by_class(df, "bad", ["apply_date", "price", "qty", "disc", "tax", "total", "prio"])
    return out.groupBy("bad", "split").agg(F.count("*").alias("n"))


@query("SELECT yr AS year, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM loans GROUP BY yr")
def split_by_year(spark: SparkSession, df: DataFrame) -> DataFrame:
    return splitting.by_year(df, "apply_date", "bad")


@query(f"SELECT count(*) AS n, count(*) FILTER (qty > 10 AND qty <= 20 AND tax > 0.04) AS hits, count(*) FILTER (qty IN (-999)) AS specials, round(sum(ln(1 + price)), 2) AS log_price FROM loans WHERE yr BETWEEN 1996 AND 2000")
def predicates_and_functions(spark: SparkSession, df: DataFrame) -> DataFrame:
    rule = rules.Rule((rules.Part("qty", 10.0, 20.0), rules.Part("tax", 0.04)), 0, 0)
    return df.where(F.col("yr").between(1996, 2000)).agg(
        F.count("*").alias("n"), F.count_if(rule.column()).alias("hits"), F.count_if(F.col("qty").isin(*SPECIALS)).alias("specials"), F.round(F.sum(F.log1p("price")), 2).alias("log_price")
    )


@query(f"SELECT CAST(len(list_filter({list(TAX_CUTS)}, lambda x: x <= tax)) AS INT) AS bin, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM loans WHERE tax IS NOT NULL GROUP BY ALL")
def bins_left_closed(spark: SparkSession, df: DataFrame) -> DataFrame:
    own = df.where("tax IS NOT NULL")
    return own.groupBy(bin_index(F.col("tax"), list(TAX_CUTS), right=False).alias("bin")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))


@query()
def chain_end_to_end(spark: SparkSession, df: DataFrame) -> DataFrame:
    with kept(df) as df:
        train, test, oot = samples(df)
        chain = Chain().read(train, target="bad", test=test, oot=oot).prefilter(iv_range=(None, None)).bin(n_bins=5, special_values=SPECIALS).refine(iv_range=(0.001, None)).transform().select(n_min=2, n_max=5, random_state=1).fit().scorecard()
        return chain.evaluate_frame()
