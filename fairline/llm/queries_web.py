"""Registered queries over ``pages``: URL rules and WARC archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import table
from fairline.llm.url_rules import judge
from fairline.llm.warc import archive

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


_RULES_SQL = ", ".join(str(r) for r in RULES)
_OP1_SQL = f"""
WITH rules(rh, rp, v) AS (VALUES {_RULES_SQL}),
urls AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS n
  FROM pages
),
fits AS (
  SELECT n, rh || rp AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC) AS r
  FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM urls LEFT JOIN fits ON urls.n = fits.n AND fits.r = 1
"""


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record as read back from normalised archives."""
    found = archive(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {"op7_warc": (op7_warc, None), "op1_url_filters": (op1_url_filters, _OP1_SQL)}
