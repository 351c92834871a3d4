"""op3: passages of 50 words that an earlier document has leave the later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import table
from latticework.llm.substring_dedup import drop_repeated_passages


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. Null and empty texts have no words; rows of one doc_id are one document; a null doc_id keeps all its words; no document gives no row."""
    out = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLES = {
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM v),
f AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM h JOIN f USING (h) WHERE doc_id > lo),
p AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (SELECT p.doc_id, string_agg(p.x, ' ' ORDER BY p.pos) AS left_text, count(*) AS n FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.pos = r.pos GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.left_text, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
}
