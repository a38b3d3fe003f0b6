"""Files: CSV tables, variable presets, adapters of public credit data, and sinks for rules."""

from __future__ import annotations

import csv
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import is_numeric, without_nan
from ..functions.kernels import TREND_CODES

ADAPTERS = ("gmsc", "home_credit", "lending_club", "lending_club_wide")
MAX_MISSING, MAX_FEATURES = 0.55, 80
# Endings of a loan, and column name parts that are known only after it.
BAD_STATUS = ("Charged Off", "Default", "Does not meet the credit policy. Status:Charged Off", "Late (31-120 days)")
GOOD_STATUS = ("Fully Paid", "Does not meet the credit policy. Status:Fully Paid")
LEAKS = ("recover", "collection", "total_pymnt", "total_rec", "last_pymnt", "last_fico", "out_prncp", "settlement", "hardship", "next_pymnt", "debt_settlement")


def read_csv(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A CSV file with a header, types inferred, NaN as NULL."""
    return without_nan(spark.read.options(**{"header": True, "inferSchema": True} | options).csv(path))


def checked_columns(df: DataFrame, target: str | None = None, id_col: str | None = None) -> DataFrame:
    """df, or a ValueError for repeated labels and absent columns."""
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    absent = [c for c in (target, id_col) if c is not None and c not in df.columns]
    if repeated or absent:
        raise ValueError(f"repeated columns {repeated}, absent columns {absent}")
    return df


@dataclass
class Presets:
    feature_config: dict[str, dict] = field(default_factory=dict)
    """variable -> monotonic and special_values, for binning"""
    feature_belong: dict[str, str] = field(default_factory=dict)


def load_presets(path: str) -> Presets:
    """Presets from a CSV file with the columns variable, monotonic, special_values (comma-separated) and dimension.

    Rows without a variable are skipped and unknown trends ignored, both with a warning.
    """
    out = Presets()
    with open(path, newline="", encoding="utf-8-sig") as file:
        for row in csv.DictReader(file):
            name = (row.get("variable") or "").strip()
            if not name:
                warnings.warn("a row without a variable is skipped", stacklevel=2)
                continue
            own: dict = {}
            trend = (row.get("monotonic") or "").strip().lower()
            if trend and trend in TREND_CODES:
                own["monotonic"] = trend
            elif trend and trend != "none":
                warnings.warn(f"{name}: the trend {trend!r} is unknown", stacklevel=2)
            if values := (row.get("special_values") or "").strip():
                own["special_values"] = tuple(float(x) for x in values.split(","))
            out.feature_config[name] = own
            if dimension := (row.get("dimension") or "").strip():
                out.feature_belong[name] = dimension
    return out


def write_rules(table: DataFrame, path: str) -> None:
    """A table of rules as one CSV file in a folder; it is small by its limit."""
    table.coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def source_of(columns: list[str]) -> str:
    """Which public data set a table is, by its columns."""
    names = {c.lower() for c in columns}
    if "seriousdlqin2yrs" in names:
        return "gmsc"
    if "target" in names and "days_birth" in names or "days_decision" in names:
        return "home_credit"
    if "loan_status" in names:
        return "lending_club_wide"
    if {"fico_n", "dti_n"} & names:
        return "lending_club"
    raise ValueError("unknown columns; name the source")


def prepare(df: DataFrame, source: str | None = None, sample: float | None = None, seed: int = 42) -> DataFrame:
    """A modelling table of a public data set: target (1 = bad), apply_year, and its usable features."""
    source = source or source_of(df.columns)
    if source not in ADAPTERS:
        raise ValueError(f"source {source!r} is none of {ADAPTERS}")
    df = without_nan(df)
    if sample:
        df = df.sample(fraction=sample, seed=seed)
    if source == "gmsc":
        features = [c for c in df.columns if c not in ("SeriousDlqin2yrs", "_c0")]
        year = 2020 + F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(4))
        return df.select(F.col("SeriousDlqin2yrs").cast("int").alias("target"), year.cast("int").alias("apply_year"), *features)
    if source == "home_credit":
        features = usable_features(df, [c for c in df.columns if c not in ("TARGET", "SK_ID_CURR") and is_numeric(df, c)])
        year = F.year(F.date_add(F.lit("2018-01-01").cast("date"), F.col("DAYS_DECISION").cast("int"))) if "DAYS_DECISION" in df.columns else 2015 + F.pmod(F.col("SK_ID_CURR"), F.lit(4))
        return df.select(F.col("TARGET").cast("int").alias("target"), year.cast("int").alias("apply_year"), *features)
    if source == "lending_club":
        target = "Default" if "Default" in df.columns else "default"
        return df.select(F.col(target).cast("int").alias("target"), F.year(F.to_date("issue_d")).alias("apply_year"), *(c for c in ("revenue", "dti_n", "loan_amnt", "fico_n", "experience_c") if c in df.columns))
    bad = F.when(F.col("loan_status").isin(*BAD_STATUS), 1).when(F.col("loan_status").isin(*GOOD_STATUS), 0)
    year = F.year(F.coalesce(F.try_to_date("issue_d", "MMM-yyyy"), F.try_to_date("issue_d", "yyyy-MM-dd")))
    percent = {c: F.regexp_replace(c, "%", "").try_cast("double") for c in ("int_rate", "revol_util") if c in df.columns and dict(df.dtypes)[c] == "string"}
    df = df.withColumns({"target": bad, "apply_year": year} | percent).where("target IS NOT NULL")
    features = [c for c in df.columns if c not in ("target", "apply_year", "id", "member_id") and is_numeric(df, c) and not any(x in c.lower() for x in LEAKS)]
    return df.select("target", "apply_year", *usable_features(df, features))


def usable_features(df: DataFrame, features: list[str], most_missing: float = MAX_MISSING, at_most: int = MAX_FEATURES) -> list[str]:
    """Features missing in at most that share of rows, those least often missing first; one aggregate for all."""
    if not features:
        return []
    row = df.agg(F.count("*"), *(F.count(c) for c in features)).first()
    rates = {c: 1 - n / row[0] if row[0] else 1.0 for c, n in zip(features, row[1:], strict=True)}
    return sorted((c for c in features if rates[c] <= most_missing), key=lambda c: (rates[c], c))[:at_most]
