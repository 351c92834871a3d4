"""Cross-validated benchmarks: folds, models, timed scores, reports and the leaderboard."""

from __future__ import annotations

import importlib.metadata
import platform
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.plans.metrics import REGRESSION, TOPS, mean_and_std, predict_group_mean, regression_metrics, top_n_in_top_k
from latticework.plans.splits import fold_grouped, quantile_bin
from latticework.shared import written

REPORT = """name string, task string, version string, features string, model_type string, reference string, implementation string, report_id string, start_time string, end_time string,
metrics struct<regression_metrics: array<map<string,double>>, fit_timings: array<double>, inference_timings: array<double>>, session_info map<string,string>, logs array<map<string,string>>"""


@dataclass(frozen=True)
class Task:
    """A benchmark: the data's label, and how folds are made: (df, k) to df with a column fold."""

    name: str
    label: str
    folds: Callable[[DataFrame, int], DataFrame]
    k: int = 5


# Fixed values: (task, label column, group column or number of density edges) of the four published tasks.
TASKS = {
    "CH4DC_ID": ("outputs.CH4DC", "info.undecorated_scaffold_hash", None),
    "LogKHCO2_ID": ("outputs.logKH_CO2", "info.undecorated_scaffold_hash", None),
    "LogKHCO2_OOD": ("outputs.logKH_CO2", None, 6),
    "PBEBandGap_ID": ("outputs.pbe.bandgap", "info.undecorated_scaffold_hash", None),
}


class GroupMean:
    """A model: the mean or median label of the training rows, of the row's group where it has one."""

    def __init__(self, strategy: str = "mean", by: list[str] | None = None) -> None:
        self.strategy, self.by = strategy, by

    def fit(self, train: DataFrame, label: str) -> Callable[[DataFrame], DataFrame]:
        return lambda test: predict_group_mean(train, test, label, self.strategy, self.by)


class Pipelined:
    """A model: any Spark ML estimator over named feature columns."""

    def __init__(self, estimator: Estimator, features: list[str]) -> None:
        self.estimator, self.features = estimator, features

    def fit(self, train: DataFrame, label: str) -> Callable[[DataFrame], DataFrame]:
        stages = [VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="skip"), self.estimator.copy({self.estimator.labelCol: label})]
        return Pipeline(stages=stages).fit(train).transform


def density_model(label: str, column: str = "info.density") -> Pipeline:
    """Scaled density, its powers to the third, and least squares."""
    return Pipeline(stages=[VectorAssembler(inputCols=[column], outputCol="__d"), StandardScaler(inputCol="__d", outputCol="__s", withMean=True), PolynomialExpansion(degree=3, inputCol="__s", outputCol="features"), LinearRegression(labelCol=label)])


def environment() -> dict[str, str]:
    found = {d.metadata["Name"]: d.version for d in importlib.metadata.distributions() if d.metadata["Name"] in ("pyspark", "numpy", "pandas", "pyarrow")}
    return found | {"python": sys.version.split()[0], "system": platform.platform()}


def report_id(name: Column, implementation: Column, stamp: Column) -> Column:
    """Parts of the names and of their digest, and the time: readable, and the same for the same report."""
    digest = F.translate(F.base64(F.unhex(F.sha1(F.concat(name, implementation).cast("binary")))), "+/", "-_")
    return F.concat(F.lit("R"), F.substring(name, 1, 4), F.substring(digest, 1, 4), stamp)


def report_id_of_parts(name: Column, features: Column, model_type: Column, reference: Column, whole: Column, stamp: Column) -> Column:
    """The id of a report: two letters of each of four fields, of the digest of the whole report where a field is null or empty, and the time. Slashes and spaces are replaced."""
    digest = F.translate(F.base64(F.unhex(F.sha1(whole.cast("binary")))), "+/", "-_")
    part = lambda c, i: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.substring(c, 1, 2)).otherwise(F.substring(digest, 1 + 2 * i, 2))
    return F.translate(F.concat(F.lit("R"), *[part(c, i) for i, c in enumerate((name, features, model_type, reference))], stamp), "/ ", "-_")


def task_of(name: str, k: int = 5, seed: int = 0) -> Task:
    """A published task, to be run on the frame of its dataset: folds of whole groups of equal hashes, or of density bins."""
    label, group, bins = TASKS[name]
    if group:
        return Task(name, label, lambda df, k: fold_grouped(df, f"`{group}`", k, seed), k)
    edges = tuple(i / (bins - 1) for i in range(bins))
    return Task(name, label, lambda df, k: fold_grouped(quantile_bin(df, "`info.density`", edges, "__bin"), "__bin", k, seed).drop("__bin"), min(k, bins - 1))


def timings(reports: DataFrame) -> DataFrame:
    """(task, name, means and population deviations) of fit and inference times over folds."""
    long = reports.select("task", "name", F.explode(F.arrays_zip("metrics.fit_timings", "metrics.inference_timings")).alias("t")).select("task", "name", "t.fit_timings", "t.inference_timings")
    return mean_and_std(long, ("fit_timings", "inference_timings"), ["task", "name"])


def run(spark: SparkSession, task: Task, df: DataFrame, model, key: str, name: str, **about: str) -> DataFrame:
    """One row of REPORT: the model fitted and scored k times, a fold held out each time.

    The folds are written once; a fold's rows never meet on the driver.
    """
    folds, started = written(task.folds(df, task.k), "folds"), time.time()
    metrics, fits, guesses = [], [], []
    for i in range(task.k):
        t = time.time()
        predict = model.fit(folds.where(F.col("fold") != i), task.label)
        fits.append(time.time() - t)
        t = time.time()
        scored = written(predict(folds.where(F.col("fold") == i)).select(key, task.label, "prediction"), "scored")
        guesses.append(time.time() - t)
        row = regression_metrics(scored, task.label, "prediction").first().asDict()
        for n in TOPS:
            row[f"top_{n}_in_top_{n}"] = float(top_n_in_top_k(scored, key, task.label, "prediction", n, n).first().hits)
        metrics.append({k: None if v is None else float(v) for k, v in row.items()})
    stamp = lambda t: time.strftime("%Y%m%d%H%M%S", time.gmtime(t))
    own = {k: about.get(k) for k in ("version", "features", "model_type", "reference", "implementation")}
    ident = spark.range(1).select(report_id(F.lit(name), F.lit(own["implementation"] or ""), F.lit(stamp(time.time()))).alias("i")).first().i
    row = (name, task.name, own["version"], own["features"], own["model_type"], own["reference"], own["implementation"], ident, stamp(started), stamp(time.time()), (metrics, fits, guesses), environment(), [])
    return spark.createDataFrame([row], REPORT)


def save_json(report: DataFrame, folder: str) -> None:
    """Adds the report to a folder of reports; NaN is written as null."""
    report.coalesce(1).write.mode("append").json(folder)


def leaderboard(reports: DataFrame, names: tuple[str, ...] = REGRESSION) -> DataFrame:
    """(task, name, fold, metrics) of all reports."""
    return reports.select("task", "name", F.posexplode("metrics.regression_metrics").alias("fold", "m")).select("task", "name", "fold", *[F.col("m")[n].alias(n) for n in names])


def summary(board: DataFrame, names: tuple[str, ...] = REGRESSION) -> DataFrame:
    return mean_and_std(board, names, ["task", "name"])


def five_numbers(board: DataFrame, metric: str) -> DataFrame:
    """What a box plot shows of a metric for each model."""
    return board.groupBy("name").agg(F.percentile(metric, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("box"))


def model_card(reports: DataFrame) -> DataFrame:
    """(report_id, card): a page in reStructuredText for each report."""
    card = F.concat(F.col("name"), F.lit("\n"), F.repeat(F.lit("-"), F.length("name")), F.lit("\n\n.. list-table::\n\n   * - task\n     - "), F.col("task"), F.lit("\n   * - version\n     - "), F.coalesce("version", F.lit("")), F.lit("\n   * - features\n     - "), F.coalesce("features", F.lit("")), F.lit("\n"))
    return reports.select("report_id", card.alias("card"))


def search(estimator: Estimator, grid: list, evaluator, folds: DataFrame, k: int):
    """The best of a parameter grid, cross-validated over the given column fold."""
    return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=k, foldCol="fold").fit(folds)
