"""Splits by clusters of features: whole clusters, strata of clusters, and one cluster left out."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.plans.splits import downsample, fold_stratified, split_grouped, split_stratified


def clustered(df: DataFrame, features: str, clusters: int, components: int | None = 8, scaled: bool = True, seed: int = 0) -> DataFrame:
    """df with a column cluster: k-means over scaled principal components of an array column."""
    stages, at = [], "__v"
    if scaled:
        stages.append(StandardScaler(withMean=True, inputCol=at, outputCol="__s"))
        at = "__s"
    if components:
        stages.append(PCA(k=components, inputCol=at, outputCol="__p"))
        at = "__p"
    stages.append(KMeans(k=clusters, seed=seed, featuresCol=at, predictionCol="cluster"))
    own = df.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    return Pipeline(stages=stages).fit(own).transform(own).drop("__v", "__s", "__p")


def split_clusters(df: DataFrame, features: str, clusters: int, train: float, valid: float = 0.0, seed: int = 0) -> DataFrame:
    return split_grouped(clustered(df, features, clusters, seed=seed), "cluster", train, valid, seed)


def split_within_clusters(df: DataFrame, key: str, features: str, clusters: int, train: float, valid: float = 0.0, seed: int = 0) -> DataFrame:
    return split_stratified(clustered(df, features, clusters, seed=seed), key, "cluster", train, valid, seed)


def fold_within_clusters(df: DataFrame, key: str, features: str, clusters: int, k: int, seed: int = 0) -> DataFrame:
    return fold_stratified(clustered(df, features, clusters, seed=seed), key, "cluster", k, seed)


def leave_cluster_out(df: DataFrame, features: str, parts: int = 3, seed: int = 0) -> DataFrame:
    """df with a column split: the largest cluster trains, the second tests, the third validates."""
    own = clustered(df, features, parts, seed=seed)
    order = [r.cluster for r in sorted(own.groupBy("cluster").agg(F.count("*").alias("n")).collect(), key=lambda r: (-r.n, r.cluster))]
    to = F.create_map(*[F.lit(x) for c, name in zip(order, ("train", "test", "valid")) for x in (c, name)])
    return own.withColumn("split", F.coalesce(to[F.col("cluster")], F.lit("train")))


def leave_cluster_out_folds(df: DataFrame, key: str, features: str, k: int, sample_frac: float = 1.0, components: int | None = 8, seed: int = 0) -> DataFrame:
    """(the rows, fold, split) of k folds in long form: in fold i cluster i tests and the others train, or the other way round where the cluster is the larger part."""
    own = clustered(df, features, k, components, seed=seed)
    n = {r.cluster: r.n for r in own.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    larger = [c for c, m in n.items() if 2 * m > total]
    long = own.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in sorted(n)])))
    tests = (F.col("cluster") == F.col("fold")) != F.col("fold").isin(larger)
    out = long.withColumn("split", F.when(tests, "test").otherwise("train"))
    if sample_frac < 1:
        out = downsample(out.withColumn("__part", F.concat_ws("#", "fold", "split")), key, "__part", sample_frac, seed).drop("__part")
    return out


def diagram_vectors(points: DataFrame, key: str, columns: list[str], components: int, seed: int = 0) -> DataFrame:
    """(key, weights): the mean posterior of a Gaussian mixture, fitted on the points of all keys, over a key's points."""
    own = points.withColumn("__v", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))
    model = GaussianMixture(k=components, seed=seed, featuresCol="__v", probabilityCol="__p", predictionCol="__c").fit(own)
    long = model.transform(own).select(key, F.posexplode(vector_to_array("__p")).alias("component", "weight"))
    mean = long.groupBy(key, "component").agg(F.avg("weight").alias("weight"))
    return mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "weight"))), lambda s: s.getField("weight")).alias("weights"))
