"""Registered queries of the deduplication operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import table
from fairline.llm.line_dedup import remove_repeated_runs
from fairline.llm.minhash import near_duplicates
from fairline.llm.repeats import remove_repeats

LONG_LINE = 50  # words; a line of so many is a run by itself


def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Component and verdict of every document: 3-word shingles, similarity 0.85."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = near_duplicates(docs, words=3, percent=85, carry=["doc_id"])
    return found.select("row.doc_id", "n_shingles", "component_id", "kept")


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document when later runs of at least two repeated lines, and later single lines of LONG_LINE words, are deleted."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = remove_repeated_runs(docs, window=2, long_words=LONG_LINE)
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP2_SQL = rf"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM docs
),
full_lines AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
runs AS (
  SELECT a.doc_id, a.r, a.i AS i1, b.i AS i2, a.line AS l1, b.line AS l2
  FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.r = a.r + 1
),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l1, l2 ORDER BY doc_id, r) AS nth FROM runs) WHERE nth > 1
),
long_later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, r) AS nth FROM full_lines
    WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {LONG_LINE}
  ) WHERE nth > 1
),
gone AS (SELECT doc_id, i1 AS i FROM later UNION SELECT doc_id, i2 FROM later UNION SELECT doc_id, i FROM long_later),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS kept_text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id
),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ls) AS BIGINT) AS n_lines, coalesce(c.n, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.kept_text, '')) END AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id
"""

def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses to repeated strings of 200 bytes."""
    found = remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), length=200, digests=True)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


QUERIES = {
    "op9_suffix_dedup": (op9_suffix_dedup, None),
    "op2_line_dedup": (op2_line_dedup, _OP2_SQL),
    "op4_minhash_near_dedup": (op4_minhash_near_dedup, None),
}
