"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

No stage drops a row for being long or repeated. Rows without doc_id and rows that share one pass through: what a stage says of an id holds for
all of its rows, and a row without one is never a copy of another. Other columns of documents stay as they are. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import table, written
from latticework.llm.decontamination import decontaminate
from latticework.llm.lang_id import fit, identify, remainder
from latticework.llm.line_dedup import drop_repeated_lines
from latticework.llm.near_dedup import near_duplicates
from latticework.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language: null and empty texts and those without a letter. The first language by name is taken of several that code a text as well."""
    found = identify(docs, fit(docs.where(remainder(4) != 2)), docs.columns)
    return found.where("lang_pred <> 'und'").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document with a smaller id has; n_chars follows the text. A document may be left with an empty text; a line that one document repeats stays in it."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates, with all rows of that id. Null and empty texts are in no group and stay."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, with all rows of their ids. Null and empty texts hold none and stay; so do rows without id. An empty benchmark drops nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Concatenates and cuts what is left into sequences of 2048 tokens. A null or empty text is one end id; rows of one id are packed one by one."""
    return pack(docs).drop("ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL has neither the tokenizer nor the context trees.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
