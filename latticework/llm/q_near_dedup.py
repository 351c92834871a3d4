"""op1: near-duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm.common import table
from latticework.llm.near_dedup import near_duplicates


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. Null and empty texts have no shingles and link with nothing; rows of one doc_id are one document; a null doc_id has no
    component and is kept; no document gives no row.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), percent=75)


QUERIES = {"op1_near_dedup": op1_near_dedup}

#: All pairs that share a shingle are counted, then links are followed from document to document.
ORACLES = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS sh FROM w),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b WHERE 100 * n >= 75 * (len(x.sh) + len(y.sh) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, k.component_id, s.doc_id = k.component_id AS kept FROM s JOIN k ON k.a = s.doc_id
"""
}
