"""A credit-shaped view of the driver's tables: lineitem with its order, and a 0/1 target from integers of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

SPECIALS = (-999.0,)
CONTINUOUS = ["qty", "price", "total"]
NUMERIC = ["qty", "price", "disc", "tax", "total"]
CATEGORIES = ["prio", "status"]
FEATURES = NUMERIC + CATEGORIES

LOANS_SQL = """
SELECT l_shipdate AS apply_date, CAST(year(l_shipdate) AS INT) AS yr,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 9 = 0 THEN NULL WHEN l_orderkey % 41 = 0 THEN CAST(-999 AS DOUBLE) ELSE l_quantity END AS qty,
  l_extendedprice AS price, CAST(round(l_discount * 100) AS INT) AS disc,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE l_tax END AS tax, o_totalprice AS total, o_orderpriority AS prio, l_linestatus AS status,
  CASE WHEN CAST(round(l_discount * 100) AS INT) * 2 + CAST(round(l_tax * 100) AS INT) + CAST(floor(l_quantity / 10) AS INT) * 2
    + (l_orderkey * 7919 + l_linenumber * 104729) % 23 >= 42 THEN 1 ELSE 0 END AS bad
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """apply_date, yr, qty (1.6 % missing, 2.5 % special), price, disc, tax (4.3 % missing), total, prio, status, bad."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    df = item.join(order, item["l_orderkey"] == order["o_orderkey"])
    disc, key = F.round(F.col("l_discount") * 100).cast("int"), F.col("l_orderkey")
    risk = disc * 2 + F.round(F.col("l_tax") * 100).cast("int") + F.floor(F.col("l_quantity") / 10).cast("int") * 2 + (key * 7919 + F.col("l_linenumber") * 104729) % 23
    return df.select(
        F.col("l_shipdate").alias("apply_date"), F.year("l_shipdate").alias("yr"),
        F.when((F.col("l_linenumber") == 1) & (key % 9 == 0), None).when(key % 41 == 0, -999.0).otherwise(F.col("l_quantity")).alias("qty"),
        F.col("l_extendedprice").alias("price"), disc.alias("disc"), F.when(key % 23 != 0, F.col("l_tax")).alias("tax"),
        F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("prio"), F.col("l_linestatus").alias("status"), F.when(risk >= 42, 1).otherwise(0).alias("bad"),
    )


def samples(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train (to 1998), test (1999) and out-of-time (from 2000) rows."""
    return df.where("yr <= 1998"), df.where("yr = 1999"), df.where("yr >= 2000")
