"""Metrics of predictions, of folds, and of the difference between two samples."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.plans.splits import fold_stratified

EPSILON = 2.220446049250313e-16
REGRESSION = ("mean_squared_error", "mean_absolute_error", "r2_score", "max_error", "mean_absolute_percentage_error")
TOPS = (5, 10, 50, 100, 500)


def regression_metrics(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """The five regression metrics, for each group of `by`, in one aggregation: the variance of labels needs no second pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    return df.groupBy(*(by or [])).agg(
        F.avg(e * e).alias("mean_squared_error"),
        F.avg(F.abs(e)).alias("mean_absolute_error"),
        (1 - F.avg(e * e) / F.var_pop(y)).alias("r2_score"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mean_absolute_percentage_error"),
    )


def top_n_in_top_k(df: DataFrame, key: str, label: str, prediction: str, n: int, k: int, maximize: bool = True) -> DataFrame:
    """(k, n, hits): how many of the n best labels are among the k best predictions, ties by key. Two bounded sorts, no window."""
    way = (lambda c: F.col(c).desc()) if maximize else (lambda c: F.col(c).asc())
    best = df.orderBy(way(label), key).limit(n).select(key)
    top = df.orderBy(way(prediction), key).limit(k).select(key)
    return best.join(top, key, "left_semi").agg(F.count("*").alias("hits")).select(F.lit(k).alias("k"), F.lit(n).alias("n"), "hits")


def predict_group_mean(train: DataFrame, test: DataFrame, label: str, strategy: str = "mean", by: list[str] | None = None) -> DataFrame:
    """test with a column prediction: the mean or median label of train, of the row's group if it has one there."""
    make = F.avg(label) if strategy == "mean" else F.percentile(label, F.lit(0.5))
    whole = train.agg(make.alias("__all"))
    out = test.crossJoin(F.broadcast(whole))
    if not by:
        return out.withColumnRenamed("__all", "prediction")
    own = train.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(make.alias("__own"))
    out = out.join(own, [F.col(c) == F.col(f"__{c}") for c in by], "left")
    return out.withColumn("prediction", F.coalesce("__own", "__all")).drop("__own", "__all", *[f"__{c}" for c in by])


def mean_and_std(folds: DataFrame, names: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of each metric over folds."""
    return folds.groupBy(*(by or [])).agg(*[g(n).alias(f"{n}_{k}") for n in names for k, g in (("mean", F.avg), ("std", F.stddev_pop))])


def concatenated(folds: DataFrame, names: tuple[str, ...], fold: str = "fold") -> DataFrame:
    """Each metric's values over folds, in their order."""
    return folds.agg(*[F.array_sort(F.collect_list(F.struct(fold, n))).getField(n).alias(n) for n in names])


def auc_by_rank(df: DataFrame, score: str, label: str) -> DataFrame:
    """The area under the ROC curve of a score for a 0/1 label, ties counting half, from counts of equal scores.

    Only distinct scores are ranked, by range and prefix sums.
    """
    from latticework.shared import running

    count = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"))
    own = running(count, "s", "neg")
    return own.agg((F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def labelled_union(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    return a.withColumn(label, F.lit(0)).unionByName(b.withColumn(label, F.lit(1)))


def adversarial(a: DataFrame, b: DataFrame, features: list[str], key: str, k: int = 5, seed: int = 0) -> tuple[list[float], dict[str, float]]:
    """(AUC of each fold, importance of each feature) of a forest that tells the two samples apart."""
    folds = fold_stratified(labelled_union(a, b).withColumn("__k", F.concat_ws("#", "label", key)), "__k", "label", k, seed).cache()
    scores, gain = [], [0.0] * len(features)
    for i in range(k):
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__features"), RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=20, seed=seed)]).fit(folds.where(F.col("fold") != i))
        scores.append(BinaryClassificationEvaluator(labelCol="label").evaluate(model.transform(folds.where(F.col("fold") == i))))
        gain = [g + float(x) / k for g, x in zip(gain, model.stages[-1].featureImportances.toArray())]
    folds.unpersist()
    return scores, dict(zip(features, gain))


def pearson(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, correlation), the strongest first."""
    one = df.agg(*[F.corr(f, label).alias(f) for f in features])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f) for f in features]))).alias("feature", "correlation")).orderBy(F.abs("correlation").desc())


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the average rank of a column's values, equal ones alike: the distinct values are ranked, not the rows."""
    from latticework.shared import running

    count = df.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__c"))
    rank = running(count, "__v", "__c").select("__v", (F.col("before___c") + (F.col("__c") + 1) / 2).alias(name))
    return df.join(rank, F.col(column).eqNullSafe(F.col("__v"))).drop("__v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    own = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return average_rank(average_rank(own, a, "__ra"), b, "__rb").agg(F.corr("__ra", "__rb").alias("correlation"))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[g(c).alias(f"__{k}_{c}") for c in columns for k, g in (("m", F.avg), ("s", F.stddev_pop))])
    met = df.crossJoin(F.broadcast(one))
    scale: list[Column] = [((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)).alias(c) for c in columns]
    return met.select(*[c for c in df.columns if c not in columns], *scale)
