"""op6: quality rules over every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm.common import table
from latticework.llm.quality import STOCK, judged


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. Null and empty texts have no words, fail and aren't kept; repeated rows are judged one by one; no document gives no row."""
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")


QUERIES = {"op6_quality": op6_quality}
ORACLES = {
    "op6_quality": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) AS h FROM g),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM h) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM d) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, len(string_split(t, chr(10))) AS of FROM t),
m AS (SELECT doc_id, of, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
  length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS solid, length(line) - length(translate(line, '#*$%&|<>', '')) AS sym,
  len(regexp_extract_all(line, '[|»›→]')) AS bars, len(regexp_extract_all(line, '[!?]{2,}')) AS shouts, regexp_matches(line, '[.!?…。]["''”’»)\]]*(?:[\x20\x09-\x0D]|$)') AS ends,
  length(regexp_replace(line, '[^\pL]+', '', 'g')) AS let,
  length(regexp_replace(line, '[^\p{Lu}]+', '', 'g')) AS cap, lower(line) AS low FROM l),
x AS (SELECT doc_id, CAST(coalesce(sum(solid), 0) AS BIGINT) AS lost FROM m
  WHERE 100 * sym > 20 * n OR 100 * bars > 20 * n OR 100 * shouts > 20 * n OR (n >= 12 AND NOT ends AND of > 1) OR (let >= 12 AND 100 * cap > 70 * let) OR (solid > 0 AND let = 0)
    OR (n <= 12 AND (@STOCK@)) GROUP BY doc_id),
r AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(x.lost, 0) AS lost_chars
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN x ON x.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM b
""".replace("@STOCK@", " OR ".join(f"contains(low, '{x}')" for x in STOCK))
}
