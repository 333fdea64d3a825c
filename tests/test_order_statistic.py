"""The exact order statistic over many distinct, clustered and repeated values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.parsing import order_statistic, upper_median

SHAPES = {
    "uniform": "rand(1)", "clustered": "CASE WHEN rand(1) < 0.9 THEN 100 + rand(2) * 1e-9 ELSE rand(3) * 1e12 END", "exponential": "exp(rand(1) * 200 - 100)",
    "few": "CAST(rand(1) * 5 AS INT) * 1.0", "signs": "(rand(1) - 0.5) * exp(rand(2) * 30)", "one": "7.0",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_many_values(spark, tmp_path, shape):
    spark.range(0, 60_000, 1, 4).selectExpr(f"{SHAPES[shape]} AS x").write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x").union(spark.range(50).select(F.lit(None).cast("double")))
    values = np.sort([r.x for r in df.collect() if r.x is not None])
    for share in (0.5, 0.75, 0.01):
        assert order_statistic(df, "x", share, "q").first().q == values[int(len(values) * share)]


def test_few_and_none(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (None,), (2.0,), (2.0,)], "x double")
    assert upper_median(df, "x").first().median == 2.0 and upper_median(df.filter("x = 3"), "x").first().median == 3.0
    assert upper_median(df.limit(0), "x").first().median is None
    whole = spark.createDataFrame([(i,) for i in (5, -4, 9)], "x long")
    assert order_statistic(whole, "x", 0.75, "q").first().q == 9
