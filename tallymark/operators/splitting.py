"""Splits of a table by time and by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_time(df: DataFrame, time: str, dev: tuple, oot: tuple) -> tuple[DataFrame, DataFrame]:
    """Rows of the development and of the out-of-time range; all bounds inclusive, None is open; the ranges may overlap."""

    def within(low: object, high: object) -> Column:
        at = F.col(time).cast("timestamp")
        test = at.isNotNull()
        if low is not None:
            test &= at >= F.lit(low).cast("timestamp")
        if high is not None:
            test &= at <= F.lit(high).cast("timestamp")
        return test

    return df.where(within(*dev)), df.where(within(*oot))


def split_by_class(df: DataFrame, target: str, key: list[str], ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """df with `split`: in every class the rows of least hash of the key, ratio of them (rounded up), are train, the others test.

    A class is cut into cells by the hash, which are counted first, so that no task ranks a whole class. Both sides get a row if
    there are two.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_cell", F.shiftrightunsigned("_h", 54))
    cells = hashed.groupBy(target, "_cell").agg(F.count("*").alias("_n"))
    line, whole = Window.partitionBy(target).orderBy("_cell"), Window.partitionBy(target)
    cells = cells.select(F.col(target).alias("_t"), F.col("_cell").alias("_c"), (F.sum("_n").over(line) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    unsigned = [F.shiftrightunsigned("_h", 1), F.col("_h"), *key]
    ranked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy(target, "_cell").orderBy(*unsigned)))
    ranked = ranked.join(cells, F.col(target).eqNullSafe(F.col("_t")) & (F.col("_cell") == F.col("_c")))
    wanted = F.greatest(F.lit(1), F.least(F.ceil(F.col("_all") * F.lit(ratio)), F.greatest(F.lit(1), F.col("_all") - 1)))
    side = F.when(F.col("_before") + F.col("_rank") <= wanted, "train").otherwise("test")
    return ranked.withColumn("split", side).select(*df.columns, "split")


def by_year(df: DataFrame, time: str, target: str) -> DataFrame:
    return df.groupBy(F.year(time).alias("year")).agg(F.count("*").alias("n"), F.sum(target).alias("bad")).where("year IS NOT NULL")
