"""Betting-shaped views of the given tables: every row of a table plays a part in its view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SPLITS_A_CORE = 2


def spread(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a scan evenly, before work that is heavy per row and so needs more tasks than the scan has splits.

    A scan with splits enough for all cores is left as it is: dealing it out would only write it to disk once more.
    """
    if scan.rdd.getNumPartitions() >= SPLITS_A_CORE * scan.sparkSession.sparkContext.defaultParallelism:
        return scan
    return scan.repartition(int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions")))


ROWS_PER_TASK = 1 << 20


def tasks(spark: SparkSession, folder: str, name: str, rows: int = ROWS_PER_TASK) -> int:
    """Tasks to deal a table's rows out over: a million rows each at most, but no fewer than any shuffle has. Counts from file footers."""
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(fewest, -(-table(spark, folder, name).count() // rows))


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as quotes: order = event, part = outcome, supplier = book."""
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("book-"), (F.col("l_suppkey") % 7).cast("string")).alias("bookmaker"),
        F.col("l_orderkey").cast("string").alias("event_id"),
        F.expr("CASE l_partkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END").alias("selection_type"),
        F.expr(
            "CASE WHEN l_returnflag <> 'R' THEN CAST(1 + CAST(l_discount AS DECIMAL(18,8)) "
            "+ CAST(l_quantity AS DECIMAL(18,8)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(18,8)) END"
        ).alias("decimal_odds"),
        (F.col("l_returnflag") != "R").alias("is_available"),
        F.col("l_shipdate").alias("observed_at"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
    )


QUOTES_SQL = """
  SELECT concat('book-', CAST(l_suppkey % 7 AS VARCHAR)) AS bookmaker, CAST(l_orderkey AS VARCHAR) AS event_id,
    CASE l_partkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS selection_type,
    CASE WHEN l_returnflag <> 'R' THEN CAST(1 + CAST(l_discount AS DECIMAL(18,8))
      + CAST(l_quantity AS DECIMAL(18,8)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(18,8)) END AS decimal_odds,
    l_returnflag <> 'R' AS is_available, l_shipdate AS observed_at, l_linenumber AS seq, l_partkey AS pk,
    l_suppkey AS sk
  FROM lineitem
"""

QUOTE_ORDER = ["observed_at", "seq", "pk", "sk"]
QUOTE_SERIES = ["event_id", "selection_type", "bookmaker"]


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """events as price ticks; prices are coarse, so some repeat."""
    return as_ticks(table(spark, folder, "events"))


def as_ticks(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("book-"), (F.col("user_id") % 5).cast("string")).alias("bookmaker"),
        F.concat_ws("-", "event_type", (F.col("user_id") % 11).cast("string")).alias("selection_id"),
        F.expr(
            "CASE WHEN value > 0 THEN CAST(CAST(1.5 AS DECIMAL(18,8)) + CAST(floor(value/25) AS DECIMAL(18,8)) "
            "* CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(18,8)) END"
        ).alias("decimal_odds"),
        (F.col("value") > 0).alias("is_available"),
        "ts",
        "event_id",
    )


TICKS_SQL = """
  SELECT concat('book-', CAST(user_id % 5 AS VARCHAR)) AS bookmaker,
    concat(event_type, '-', CAST(user_id % 11 AS VARCHAR)) AS selection_id,
    CASE WHEN value > 0 THEN CAST(CAST(1.5 AS DECIMAL(18,8)) + CAST(floor(value/25) AS DECIMAL(18,8))
      * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(18,8)) END AS decimal_odds,
    value > 0 AS is_available, ts, event_id
  FROM events
"""

TICK_SERIES = ["selection_id", "bookmaker"]
TICK_ORDER = ["ts", "event_id"]

PARTICIPANT_NAME = (
    "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, '''s') "
    "WHEN 2 THEN concat(p_name, ' united') ELSE concat('zz', reverse(p_name)) END"
)


def participant_sources(spark: SparkSession, folder: str) -> DataFrame:
    """part as a book's participants: every part is one source entity, names spelled four ways."""
    return table(spark, folder, "part").select(
        F.concat(F.lit("book-"), (F.col("p_partkey") % 3).cast("string")).alias("bookmaker_id"),
        F.col("p_partkey").cast("string").alias("source_id"),
        F.col("p_type").alias("sport_id"),
        F.expr(PARTICIPANT_NAME).alias("name"),
        F.expr("CASE WHEN p_size % 2 = 0 THEN 'team' END").alias("participant_type"),
        F.lit(None).cast("string").alias("country_code"),
    )


PARTICIPANT_SOURCES_SQL = f"""
  SELECT concat('book-', CAST(p_partkey % 3 AS VARCHAR)) AS bookmaker_id, CAST(p_partkey AS VARCHAR) AS source_id,
    p_type AS sport_id, {PARTICIPANT_NAME} AS name, CASE WHEN p_size % 2 = 0 THEN 'team' END AS participant_type
  FROM part
"""


def participant_entities(spark: SparkSession, folder: str) -> DataFrame:
    """part as the canonical table: one entity per (type, name)."""
    return (
        table(spark, folder, "part")
        .groupBy("p_type", "p_name")
        .agg(F.lpad(F.min("p_partkey").cast("string"), 12, "0").alias("id"))
        .select(
            "id",
            F.col("p_type").alias("sport_id"),
            F.col("p_name").alias("name"),
            F.lit("team").alias("participant_type"),
            F.lit(None).cast("string").alias("country_code"),
        )
    )


PARTICIPANT_ENTITIES_SQL = """
  SELECT lpad(CAST(min(p_partkey) AS VARCHAR), 12, '0') AS id, p_type AS sport_id, p_name AS name
  FROM part GROUP BY p_type, p_name
"""
