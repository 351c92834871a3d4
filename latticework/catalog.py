"""Every query of the engine by name, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticework.plans import queries_data, queries_models, queries_more

FLAGSHIP = queries_models.metrics_by_fold


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return queries_data.Q | queries_models.Q | queries_more.Q


def oracle_sql() -> dict[str, str]:
    return queries_data.S | queries_models.S | queries_more.S
