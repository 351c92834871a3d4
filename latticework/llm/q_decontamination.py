"""op10: documents that hold an item of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm.common import table
from latticework.llm.decontamination import contaminated


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it holds. Null and empty texts hold none, null and empty items are not looked for; repeated rows
    are searched one by one; without documents or items there is no row.
    """
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {}
