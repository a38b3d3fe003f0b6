import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions.expressions import bin_index


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 300])
def test_bin_index_counts_cuts(spark, n):
    r = random.Random(n)
    cuts = sorted(r.sample(range(1000), n))
    values = [None, -5.0, 2000.0, *(float(c) for c in cuts[:20]), *(r.uniform(0, 1000) for _ in range(50))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for v, a, b in df.select("x", bin_index(F.col("x"), cuts), bin_index(F.col("x"), cuts, right=False)).collect():
        assert (a, b) == ((None, None) if v is None else (sum(c < v for c in cuts), sum(c <= v for c in cuts)))
