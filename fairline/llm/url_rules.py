"""URL rules by host-suffix and path-prefix expressions.

A url is expanded into the expressions that could name it: each suffix of its host at a dot, with each prefix of its path
that ends in a slash (and the empty one). A rule is filed under its host and its path up to the last slash. Expressions
meet rules by a short hash prefix of that key; the full digest of host and key then confirms, and the rule's whole path is
compared with the url's. Of the rules that fit, the longest decides.

Expressions such as ``com/`` belong to a large part of all urls, so both sides are salted: rules, which are few, are
repeated for each salt, and an expression takes the salt of its url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import whole

PREFIX_CHARS = 8  # hexadecimal digits of the digest that are joined on
SALTS = 8
DEFAULT = "allow"  # verdict where no rule fits

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, found, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, found, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Every row of ``pages`` as struct ``row`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and all subdomains if the url's
    path starts with the rule's. The longest rule (host and path) wins, then the longer host; of equal rules block wins.
    ``rule`` is the rule's host and path; without a fitting rule it is null and the verdict ``allow``. Null urls and urls without
    ``://`` have an empty host and path, which only a rule with an empty host fits. Rules with a null are left out.
    Repeated rows stay, each with its verdict; other columns are only carried.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("n"), whole(pages), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split("path", "/", -1)
    paths = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    spread = rows.withColumn("on_host", F.explode(hosts)).withColumn("on_path", F.explode(paths)).withColumn("digest", _digest(F.col("on_host"), F.col("on_path")))
    spread = spread.select("n", "row", "host", "path", F.substring("digest", 1, PREFIX_CHARS).alias("short"), "digest", F.pmod(F.xxhash64("n"), F.lit(SALTS)).alias("salt"))

    filed = rules.where("host is not null and path is not null and verdict is not null").select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    filed = filed.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("rule_host"), F.regexp_extract("rule_path", r"(?s)^(.*/)?", 0))
    filed = filed.select("*", digest.alias("rule_digest")).select("*", F.substring("rule_digest", 1, PREFIX_CHARS).alias("short"))
    filed = filed.withColumn("salt", F.explode(F.array([F.lit(s).cast("long") for s in range(SALTS)])))

    met = spread.join(filed, ["short", "salt"], "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    size = F.length("rule_host") + F.length("rule_path")
    rank = F.when(fits, F.struct(size.alias("size"), F.length("rule_host").alias("own"), F.concat("rule_host", "rule_path").alias("rule"), "verdict"))
    best = met.groupBy("n").agg(F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(rank).alias("best"))
    return best.select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))
