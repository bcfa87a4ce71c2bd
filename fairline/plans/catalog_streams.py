"""Registered streaming queries: the events table read as a file stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions import keys
from fairline.plans import views
from fairline.plans.catalog_history import _DAY_KEY_SQL
from fairline.plans.views import TICK_ORDER, TICK_SERIES, TICKS_SQL
from fairline.streaming import quotes


def _tick_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = views.table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return views.as_ticks(raw).withColumn("ts", F.col("ts").cast("timestamp"))


def _late_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The events dealt over several files and read one at a time, so most rows of a batch are late for those before."""
    source = quotes.new_folder(spark, "late-ticks")
    views.table(spark, folder, "events").repartition(FILES, F.pmod(F.xxhash64("event_id"), F.lit(FILES))).write.parquet(source)
    schema = views.table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return views.as_ticks(raw).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Replay-safe append of the stream from files out of order, started twice over the same files."""
    target = quotes.new_folder(spark, "stream-dedup")
    for attempt in ("first", "replay"):
        keyed = _late_ticks(spark, folder).withColumn(
            "observation_key",
            keys.observation_key(
                F.col("bookmaker"), F.col("selection_id"), F.col("decimal_odds"), F.col("is_available"), F.col("ts"),
                F.date_trunc("day", "ts"),
            ),
        )
        quotes.append_stream(keyed, f"{target}/history", f"{target}/{attempt}", TICK_ORDER, time="ts").awaitTermination()
    return spark.read.parquet(f"{target}/history").select("observation_key", "bookmaker", "selection_id", "decimal_odds")


def stream_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes per series after files that come out of order."""
    target = quotes.new_folder(spark, "stream-changes")
    quotes.change_stream(
        _late_ticks(spark, folder), f"{target}/out", f"{target}/state", f"{target}/progress", TICK_SERIES, "ts", TICK_ORDER
    ).awaitTermination()
    return quotes.read_changes(spark, f"{target}/out", TICK_SERIES).select("event_id", "bookmaker", "selection_id", "decimal_odds", "is_available")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Quiet-period sessions per book, each emitted when the watermark passes its end."""
    rows = quotes.to_table(quotes.sessions(_tick_stream(spark, folder), ["bookmaker"], "ts", "30 minutes"), "stream-sessions")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "last_quote")})


def stream_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars, each emitted when the watermark passes its end."""
    rows = quotes.to_table(quotes.bars(_tick_stream(spark, folder), TICK_SERIES, "ts", "1 hour", TICK_ORDER), "stream-bars")
    return rows.withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


FILES = 4
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"

QUERIES = {
    "stream_dedup": (
        stream_dedup,
        f"SELECT DISTINCT {_DAY_KEY_SQL} AS observation_key, bookmaker, selection_id, decimal_odds FROM ({TICKS_SQL}) t",
    ),
    "stream_changes": (
        stream_changes,
        f"""SELECT event_id, bookmaker, selection_id, decimal_odds, is_available FROM (SELECT *, row_number() OVER w AS rn, lag(decimal_odds) OVER w AS po,
            lag(is_available) OVER w AS pa FROM ({TICKS_SQL}) t WINDOW w AS (PARTITION BY selection_id, bookmaker ORDER BY ts, event_id))
          WHERE rn = 1 OR po IS DISTINCT FROM decimal_odds OR pa IS DISTINCT FROM is_available""",
    ),
    "stream_sessions": (
        stream_sessions,
        f"""SELECT bookmaker, min(ts) AS session_start, max(ts) AS last_quote, count(*) AS n_quotes FROM (
          SELECT *, sum(new) OVER (PARTITION BY bookmaker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY bookmaker ORDER BY ts, event_id) < INTERVAL 30 MINUTE
              THEN 0 ELSE 1 END AS new FROM ({TICKS_SQL}) t)) GROUP BY bookmaker, sid
          HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""",
    ),
    "stream_bars": (
        stream_bars,
        f"""SELECT selection_id, bookmaker, date_trunc('hour', ts)::TIMESTAMP AS bar_start, max(decimal_odds) AS high_odds, min(decimal_odds) AS low_odds,
            arg_min(decimal_odds, (ts, event_id)) AS open_odds, arg_max(decimal_odds, (ts, event_id)) AS close_odds,
            count(*) AS n_quotes FROM ({TICKS_SQL}) t WHERE decimal_odds IS NOT NULL GROUP BY 1, 2, 3
          HAVING date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR <= {_CLOSED}""",
    ),
}
