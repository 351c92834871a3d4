"""op4: all documents in sequences of 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm.common import table
from latticework.llm.packing import pack


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every piece. A null or empty text is its end id alone; rows with one or a null doc_id are packed one by one; no document gives no row."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
