"""The queries of this package: opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES, and ORACLES for those that SQL can express.
MODULES = ("q_near_dedup", "q_line_dedup", "q_substring_dedup", "q_packing", "q_html_text", "q_quality", "q_toxicity", "q_lang_id", "q_warc", "q_decontamination")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"latticework.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"latticework.llm.{m}").ORACLES.items()}
