"""Registered query of the filter audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairline.llm.common import table
from fairline.llm.interaction import filter_interactions


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All orders of five filters over all documents, by language."""
    return filter_interactions(spark, f"{folder}/documents.parquet", table(spark, folder, "labels"))


_OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
),
words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM texts
),
facts AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e
  FROM words LEFT JOIN facts USING (doc_id)
),
masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM fails GROUP BY 1, 2
),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(l, bit)),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31
),
steps AS (
  SELECT filter_order, step, bits[step] AS this, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
),
counts AS (
  SELECT part, filter_order, step, this,
    sum(n) FILTER (mask & (before | this) = 0) AS kept, sum(n) FILTER (mask & this <> 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask & this <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (mask = this) AS unique_fails,
    sum(good) FILTER (mask & this <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & this <> 0 AND mask & before = 0) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, this
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, this), 0) AS BIGINT) AS shapley
FROM counts
"""

QUERIES = {"op12_filter_audit": (op12_filter_audit, _OP12_SQL)}
