"""op5: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm.common import table
from latticework.llm.html_text import extract


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every page. A null or empty html has an empty text, a null url the empty host; repeated rows are pages of their own; no page gives no row."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLES: dict[str, str] = {}
