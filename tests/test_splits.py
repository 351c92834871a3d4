import pytest
from pyspark.sql import functions as F

from latticework.plans import splits


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(F.col("id"), (F.col("id") % 37).alias("g"), ((F.col("id") * 7919) % 1009).cast("double").alias("y")).cache()


def counts(df, c="split"):
    return {r[0]: r[1] for r in df.groupBy(c).count().collect()}


@pytest.mark.parametrize("bad", [(-1, 0, 0), (1.1, 1, 0), (0.9, 0.2, 0.1), (0.1, 0.2, 0.4)])
def test_fractions(bad):
    with pytest.raises(ValueError):
        splits.check_fractions(*bad)
    splits.check_fractions(0.8, 0.1, 0.1)


def test_sizes():
    assert splits.sizes(100, 0.5, 0.25) == (50, 25, 25)
    assert splits.sizes(7, 0.7, 0.0) == (4, 0, 3)


def test_random_covers_and_repeats(rows):
    a = splits.split_random(rows, "id", 0.7, 0.1, 3)
    assert counts(a) == {"train": 700, "valid": 100, "test": 200}
    b = splits.split_random(rows.repartition(7), "id", 0.7, 0.1, 3)
    assert a.select("id", "split").exceptAll(b.select("id", "split")).isEmpty()


def test_groups_stay_whole(rows):
    for df in (splits.split_grouped(rows, "g", 0.6, 0.2), splits.split_grouped_stratified(rows, "g", "y", 0.6, 0.2)):
        assert df.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
        assert df.count() == 1000


def test_strata_have_their_shares(rows):
    own = splits.split_stratified(splits.quantile_bin(rows, "y"), "id", "bin", 0.5, 0.25)
    for r in own.groupBy("bin").agg(F.avg((F.col("split") == "train").cast("int")).alias("t")).collect():
        assert abs(r.t - 0.5) < 0.01


def test_folds(rows):
    for df in (splits.fold_plain(rows, "id", 7), splits.fold_stratified(splits.quantile_bin(rows, "y"), "id", "bin", 7)):
        n = counts(df, "fold")
        assert sorted(n) == list(range(7)) and max(n.values()) - min(n.values()) <= 4
    grouped = splits.fold_grouped_even(rows, "g", 5)
    n = counts(grouped, "fold")
    assert sum(n.values()) == 1000 and max(n.values()) - min(n.values()) <= 28
    assert grouped.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()


def test_downsample_and_order(rows):
    own = rows.withColumn("split", F.lit("a"))
    assert splits.downsample(own.limit(100), "id", "split", 0.8).count() == 80
    late = splits.split_ordered(rows, "id", "y", 0.5)
    assert late.where("split = 'train'").agg(F.max("y")).first()[0] <= late.where("split = 'test'").agg(F.min("y")).first()[0]
    assert counts(splits.relabel_by_size(splits.split_random(rows, "id", 0.2, 0.5)))["train"] == 500


def test_empty(spark):
    none = spark.createDataFrame([], "id long, g long, y double")
    assert splits.split_random(none, "id", 0.7).count() == 0
    assert splits.split_grouped(none, "g", 0.7).count() == 0
    assert splits.quantile_bin(none, "y").count() == 0
