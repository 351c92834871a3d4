import math

import pytest
from pyspark.sql import functions as F

from latticework.functions.aggregators import COMBINERS, NAMES, aggregate, combine

# Published aggregates of 1..7.
EXPECTED = {"sum": 28, "avg": 4, "max": 7, "min": 1, "std": 2, "range": 6, "mean": 4, "median": 4, "geomean": 3.3800151591412964, "harmean": 2.6997245179063363, "mad": 2, "trimean": 4, "inf": 7, "manhattan": 28}


def test_golden(spark):
    row = aggregate(spark.range(1, 8).withColumn("g", F.lit(1)), ["g"], "id").first()
    for n in NAMES:
        assert row[n] == pytest.approx(EXPECTED[n]), n


def test_mask_leaves_norms_alone(spark):
    row = aggregate(spark.range(1, 9).withColumn("g", F.lit(1)), ["g"], "id", NAMES, F.col("id") == 8).first()
    for n in NAMES:
        assert row[n] == pytest.approx({"inf": 8, "manhattan": 36}.get(n, EXPECTED[n])), n


def test_nulls_nans_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), ("a", None), ("a", 3.0)], "g string, v double")
    rows = {r.g: r for r in aggregate(df, ["g"], "v").collect()}
    assert rows[None]["sum"] == 1 and rows["a"]["mad"] == 0 and rows["a"]["median"] == 3


def test_combiners(spark):
    row = spark.range(1).select(*[combine(n, F.lit(2.0), F.lit(5.0)).alias(n) for n in COMBINERS]).first()
    assert row.asDict() == {"sum": 7, "avg": 3.5, "max": 5, "min": 2, "first": 2, "last": 5, "product": 10, "diff": 3, "absdiff": 3}
    assert math.isclose(row["avg"], 3.5)
