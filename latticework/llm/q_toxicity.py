"""op7: the toxicity of every document, learnt from the labels outside the held-out fifth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import table
from latticework.llm.lang_id import remainder
from latticework.llm.toxicity import learn, scored


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. Null and empty texts have the score of a text that matches nothing; null labels and labels of no document teach nothing;
    a null doc_id is not held out; without documents there is no row, without labels of both kinds one score for all.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    out = scored(docs, learn(docs, labels))
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
