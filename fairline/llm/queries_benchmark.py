"""Registered query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import table
from fairline.llm.decontaminate import UNITS, WINDOW, find_items


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, as (document, item) with the item's windows and how many were found."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "n_matched", "reparameterised")


_NAME = r"([\p{Ll}\p{Nd},;] )(\p{Lu}\p{Ll}+)"


def _words(source: str, key: str) -> str:
    named = f"regexp_replace(regexp_replace(text, '{_NAME}', '\\1' || chr(1) || '\\2', 'g'), '{_NAME}', '\\1' || chr(1) || '\\2', 'g')"
    plain = f"regexp_replace(lower({named}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\x01\\x20\\x09-\\x0D]+', '', 'g')"
    numbers = f"regexp_replace({plain}, '(\\p{{Nd}}+)', ' ' || chr(2) || '\\1 ', 'g')"
    return f"SELECT DISTINCT {key} AS id, list_filter(string_split_regex({numbers}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM {source} WHERE text IS NOT NULL"


def _windows(source: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    slot = f"""CASE WHEN ascii(ws[p]) = 1 THEN chr(1) WHEN ascii(ws[p]) = 2 THEN chr(2)
      WHEN ws[p] IN ({units}) AND p > 1 AND ascii(ws[p - 1]) = 2 THEN chr(3) ELSE ws[p] END"""
    return f"""SELECT id, ws, p, array_to_string(tpl[p : p + {WINDOW - 1}], ' ') AS win,
      len(list_filter(tpl[p : p + {WINDOW - 1}], lambda w: ascii(w) <= 3)) AS slots
    FROM (SELECT id, ws, tpl, unnest(range(1, len(ws) - {WINDOW - 2})) AS p
      FROM (SELECT id, ws, list_transform(range(1, len(ws) + 1), lambda p: {slot}) AS tpl FROM {source}))"""


_OP6_SQL = f"""
WITH dw AS ({_words("documents", "doc_id")}),
bw AS ({_words("benchmark", "item_id")}),
dwin AS ({_windows("dw")}),
bwin AS (SELECT * FROM ({_windows("bw")}) WHERE 2 * slots < {WINDOW}),
hits AS (
  SELECT d.id AS doc_id, d.ws AS dws, b.id AS item_id, b.ws AS bws, d.p - b.p AS shift, b.p AS p, b.slots AS slots
  FROM dwin d JOIN bwin b ON d.win = b.win
),
pairs AS (
  SELECT DISTINCT doc_id, dws, item_id, bws, shift, bws[q] AS i, dws[q + shift] AS d
  FROM (SELECT *, unnest(range(p, p + {WINDOW})) AS q FROM hits WHERE slots > 0)
  WHERE ascii(bws[q]) <= 2 OR (bws[q] IN ({", ".join(f"'{u}'" for u in UNITS)}) AND q > 1 AND ascii(bws[q - 1]) = 2)
),
shifts AS (
  SELECT doc_id, dws, item_id, bws, shift, count(DISTINCT i) = count(*) AS good, bool_or(i <> d) AS other
  FROM pairs GROUP BY doc_id, dws, item_id, bws, shift
),
good AS (
  SELECT h.*, h.slots > 0 AND coalesce(s.other, false) AS other FROM hits h LEFT JOIN shifts s
    ON h.doc_id = s.doc_id AND h.dws = s.dws AND h.item_id = s.item_id AND h.bws = s.bws AND h.shift = s.shift
  WHERE h.slots = 0 OR s.good
),
totals AS (SELECT id, ws, count(*) AS n FROM bwin GROUP BY id, ws)
SELECT g.doc_id, g.item_id, t.n AS n_windows, count(DISTINCT g.p) AS n_matched, bool_or(g.other) AS reparameterised
FROM good g JOIN totals t ON g.item_id = t.id AND g.bws = t.ws
GROUP BY g.doc_id, g.dws, g.item_id, g.bws, t.n HAVING count(DISTINCT g.p) * 100 >= 50 * t.n
"""

QUERIES = {"op6_benchmark_decontamination": (op6_benchmark_decontamination, _OP6_SQL)}
