"""op9: every page as a WARC record, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm.common import table
from latticework.llm.warc import intact, round_trip


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every page, as the archives have it. A null html is an empty payload, a null page_id a response without revisits;
    repeated rows are records of their own; no page gives no row. Damage in an archive ends the job with an error.
    """
    found = intact(round_trip(table(spark, sf_dir, "pages"), least_bytes=0))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc": op9_warc}
ORACLES: dict[str, str] = {}
