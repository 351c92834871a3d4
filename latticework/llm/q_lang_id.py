"""op8: the language of every document, learnt from the labelled ones outside the held-out quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import table
from latticework.llm.lang_id import fit, identify, remainder


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. Null texts and those without a letter are `und`; a null doc_id is not held out; a label is learnt where it is not null;
    repeated rows are judged one by one; no document gives no row.
    """
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.where(remainder(4) != 2)))
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_lang_id": op8_lang_id}
ORACLES: dict[str, str] = {}
