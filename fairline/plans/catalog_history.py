"""Registered queries over quotes and ticks, each with its SQL for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions import keys
from fairline.operators import history
from fairline.plans import readmodels, views
from fairline.plans.views import (
    QUOTE_ORDER,
    QUOTE_SERIES,
    QUOTES_SQL,
    TICK_ORDER,
    TICK_SERIES,
    TICKS_SQL,
)

_VALUES = ["decimal_odds", "is_available", "observed_at", "seq", "pk"]
LATEST_SQL = f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id, selection_type, bookmaker
      ORDER BY observed_at DESC, seq DESC, pk DESC, sk DESC) AS rn FROM ({QUOTES_SQL}) q) WHERE rn = 1
"""
_MOMENT = "1998-06-30 00:00:00"


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    tasks = views.tasks(spark, folder, "lineitem")
    return history.latest(views.quotes(spark, folder), QUOTE_SERIES, QUOTE_ORDER, _VALUES, tasks)


def latest_odds(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(spark, folder)


def odds_as_of(spark: SparkSession, folder: str) -> DataFrame:
    moment = F.lit(_MOMENT).cast("timestamp_ntz")
    return history.as_of(
        views.quotes(spark, folder), moment, "observed_at", QUOTE_SERIES, QUOTE_ORDER, _VALUES, views.tasks(spark, folder, "lineitem")
    )


def odds_as_of_join(spark: SparkSession, folder: str) -> DataFrame:
    """Each order sees the last quote of its event at its own date."""
    probes = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderdate").alias("asked_at")
    )
    found = history.as_of_join(
        probes, views.quotes(spark, folder), ["event_id"], "asked_at", QUOTE_ORDER, ["bookmaker", "decimal_odds"]
    )
    return found.select(
        "event_id", "asked_at", F.col("quote.observed_at").alias("observed_at"), F.col("quote.pk").alias("pk"),
        F.col("quote.bookmaker").alias("bookmaker"), F.col("quote.decimal_odds").alias("decimal_odds"),
    )


def odds_history(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes of one book in a time range with their event; both bounds reach the scan."""
    rows = views.quotes(spark, folder).filter(
        (F.col("bookmaker") == "book-3")
        & (F.col("observed_at") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("observed_at") < F.lit("1999-01-01").cast("timestamp_ntz"))
    )
    events = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderdate").alias("start_time"),
        F.col("o_orderstatus").alias("event_status"),
    )
    return rows.join(events, "event_id", "left").drop("sk")


def _best(spark: SparkSession, folder: str) -> DataFrame:
    return readmodels.best_prices(_latest(spark, folder), ["event_id"], "selection_type")


def best_price(spark: SparkSession, folder: str) -> DataFrame:
    return _best(spark, folder)


_BEST_SQL = f"""
  SELECT event_id, selection_type, max(decimal_odds) AS best_odds,
    CAST(max(decimal_odds) - min(decimal_odds) AS DECIMAL(18,8)) AS price_spread, count(*) AS n_books
  FROM ({LATEST_SQL}) l WHERE is_available GROUP BY 1, 2
"""
_BEST_BOOK_SQL = f"""
  SELECT b.*, (SELECT min(l.bookmaker) FROM ({LATEST_SQL}) l WHERE l.event_id = b.event_id
    AND l.selection_type = b.selection_type AND l.is_available AND l.decimal_odds = b.best_odds) AS best_book
  FROM ({_BEST_SQL}) b
"""


def market_margin(spark: SparkSession, folder: str) -> DataFrame:
    return readmodels.market_margin(_best(spark, folder), ["event_id"], "selection_type", ["home", "draw", "away"])


def arbitrage(spark: SparkSession, folder: str) -> DataFrame:
    return market_margin(spark, folder).filter("is_arbitrage").select("event_id", "implied_ppm")


_MARGIN_SQL = f"""
  SELECT event_id, CAST((x // a + x // b + x // c + 2) // 1000000000000 AS BIGINT) AS implied_ppm,
    (a * b + b * c + a * c) * 100000000 < a * b * c AS is_arbitrage
  FROM (SELECT event_id, 100000000000000000000000000::HUGEINT AS x,
      max(n) FILTER (selection_type = 'home') AS a, max(n) FILTER (selection_type = 'draw') AS b, max(n) FILTER (selection_type = 'away') AS c
    FROM (SELECT *, CAST(CAST(best_odds AS DECIMAL(38,8)) * 100000000 AS HUGEINT) AS n FROM ({_BEST_SQL}) b) GROUP BY event_id)
  WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
"""


def line_movement(spark: SparkSession, folder: str) -> DataFrame:
    tasks = views.tasks(spark, folder, "events")
    return history.line_movement(views.ticks(spark, folder), TICK_SERIES, "ts", TICK_ORDER, tasks=tasks)


def price_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return readmodels.price_ranges(views.ticks(spark, folder), TICK_SERIES, TICK_ORDER)


def odds_bars(spark: SparkSession, folder: str) -> DataFrame:
    bars = views.ticks(spark, folder).withColumn("bar_start", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return readmodels.price_ranges(bars, [*TICK_SERIES, "bar_start"], TICK_ORDER)


def odds_bars_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """One-hour bars every fifteen minutes."""
    priced = views.ticks(spark, folder).filter("decimal_odds IS NOT NULL")
    bars = priced.groupBy(*TICK_SERIES, F.window("ts", "1 hour", "15 minutes").alias("bar")).agg(
        F.max("decimal_odds").alias("high_odds"), F.min("decimal_odds").alias("low_odds"), F.count("*").alias("n_quotes")
    )
    return bars.select(
        *TICK_SERIES, F.col("bar.start").cast("timestamp_ntz").alias("bar_start"), "high_odds", "low_odds", "n_quotes"
    )


def change_only_history(spark: SparkSession, folder: str) -> DataFrame:
    return history.change_only(views.ticks(spark, folder), TICK_SERIES, "ts", TICK_ORDER)


def quiet_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of activity with gaps under thirty minutes, per book."""
    found = history.sessions(views.ticks(spark, folder), ["bookmaker"], "ts", 1800)
    return found.withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


def _keyed_ticks(spark: SparkSession, folder: str) -> DataFrame:
    return views.ticks(spark, folder).withColumn(
        "observation_key",
        keys.observation_key(
            F.col("bookmaker"), F.col("selection_id"), F.col("decimal_odds"), F.col("is_available"),
            F.col("ts"), F.lit(None).cast("timestamp"),
        ),
    )


def observation_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed_ticks(spark, folder).select("event_id", "observation_key")


_KEY_SQL = """sha256(concat_ws('|', bookmaker, selection_id,
    CASE WHEN decimal_odds IS NULL THEN '' ELSE regexp_replace(CAST(decimal_odds AS VARCHAR), '\\.?0+$', '') END,
    CASE WHEN is_available THEN '1' ELSE '0' END, {time}))"""
_TS_SQL = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f+00:00')"
_TICK_KEY_SQL = _KEY_SQL.format(time=_TS_SQL.format("ts"))


def _daily_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks whose source only dates its updates to the day: many observations share a key."""
    return views.ticks(spark, folder).withColumn(
        "observation_key",
        keys.observation_key(
            F.col("bookmaker"), F.col("selection_id"), F.col("decimal_odds"), F.col("is_available"),
            F.col("ts"), F.date_trunc("day", "ts"),
        ),
    )


_DAY_KEY_SQL = _KEY_SQL.format(time=_TS_SQL.format("date_trunc('day', ts)::TIMESTAMP"))


def dedup_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """First observation of every key."""
    return history.first_per_key(_daily_keys(spark, folder), ["observation_key"], ["ts", "event_id"]).select(
        "observation_key", "event_id", "decimal_odds", "ts"
    )


def append_unseen(spark: SparkSession, folder: str) -> DataFrame:
    """Rows a second run appends: the first half of the month is history, the whole month arrives."""
    keyed = _daily_keys(spark, folder)
    seen = keyed.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return history.append_unseen(seen, keyed, ["observation_key"], ["ts", "event_id"]).select(
        "observation_key", "event_id"
    )


def freshness(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit("2002-01-01 00:00:00").cast("timestamp")
    return readmodels.freshness(views.quotes(spark, folder), "bookmaker", "observed_at", now)


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Hand-written rules against price moves, arbitrage and unavailable ticks."""
    rules = spark.createDataFrame(
        [("r1", "price_move", 2_000_000), ("r2", "price_move", 5_000_000), ("r3", "arbitrage", 200_000), ("r4", "unavailable", 1)],
        "rule_id string, kind string, threshold bigint",
    )
    moves = line_movement(spark, folder).filter("step IS NOT NULL").select(
        F.lit("price_move").alias("kind"), F.concat_ws("/", *TICK_SERIES).alias("subject"),
        F.col("event_id").cast("string").alias("at"),
        F.abs(F.col("step") * 1_000_000).cast("bigint").alias("amount"),
    )
    edges = arbitrage(spark, folder).select(
        F.lit("arbitrage").alias("kind"), F.col("event_id").alias("subject"), F.lit("latest").alias("at"),
        (1_000_000 - F.col("implied_ppm")).alias("amount"),
    )
    unavailable = views.quotes(spark, folder).filter(~F.col("is_available"))
    dealt = unavailable.repartition(views.tasks(spark, folder, "lineitem"), "event_id", "observed_at")
    closed = dealt.groupBy("event_id", "observed_at").agg(F.count("*").alias("amount")).select(
        F.lit("unavailable").alias("kind"), F.col("event_id").alias("subject"),
        F.date_format("observed_at", "yyyy-MM-dd").alias("at"), "amount",
    )
    return readmodels.alerts(moves.unionByName(edges).unionByName(closed), rules)


_MOVEMENT_SQL = f"""
  SELECT *, lag(decimal_odds) OVER w AS previous_odds,
    CAST(decimal_odds - lag(decimal_odds) OVER w AS DECIMAL(18,8)) AS step,
    first_value(decimal_odds) OVER r AS open_odds, max(decimal_odds) OVER r AS high_odds, min(decimal_odds) OVER r AS low_odds,
    CAST(decimal_odds - first_value(decimal_odds) OVER r AS DECIMAL(18,8)) AS move
  FROM ({TICKS_SQL}) t WHERE decimal_odds IS NOT NULL
  WINDOW w AS (PARTITION BY selection_id, bookmaker ORDER BY ts, event_id),
    r AS (PARTITION BY selection_id, bookmaker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
"""

_RANGE_COLS = """arg_min(decimal_odds, (ts, event_id)) AS open_odds, max(decimal_odds) AS high_odds,
    min(decimal_odds) AS low_odds, arg_max(decimal_odds, (ts, event_id)) AS close_odds, count(*) AS n_quotes"""

QUERIES = {
    "latest_odds": (
        latest_odds,
        f"SELECT event_id, selection_type, bookmaker, decimal_odds, is_available, observed_at, seq, pk FROM ({LATEST_SQL}) l",
    ),
    "odds_as_of": (
        odds_as_of,
        f"""SELECT event_id, selection_type, bookmaker, decimal_odds, is_available, observed_at, seq, pk FROM (
          SELECT *, row_number() OVER (PARTITION BY event_id, selection_type, bookmaker
            ORDER BY observed_at DESC, seq DESC, pk DESC, sk DESC) AS rn
          FROM ({QUOTES_SQL}) q WHERE observed_at <= TIMESTAMP '{_MOMENT}') WHERE rn = 1""",
    ),
    "odds_as_of_join": (
        odds_as_of_join,
        f"""SELECT event_id, asked_at, observed_at, pk, bookmaker, decimal_odds FROM (
          SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_orderdate AS asked_at, q.observed_at, q.pk, q.bookmaker,
            q.decimal_odds, row_number() OVER (PARTITION BY o_orderkey
              ORDER BY q.observed_at DESC NULLS LAST, q.seq DESC, q.pk DESC, q.sk DESC) AS rn
          FROM orders LEFT JOIN ({QUOTES_SQL}) q
            ON q.event_id = CAST(o_orderkey AS VARCHAR) AND q.observed_at <= o_orderdate) WHERE rn = 1""",
    ),
    "odds_history": (
        odds_history,
        f"""SELECT q.* EXCLUDE (sk), o_orderdate AS start_time, o_orderstatus AS event_status
          FROM ({QUOTES_SQL}) q LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = q.event_id
          WHERE bookmaker = 'book-3' AND observed_at >= TIMESTAMP '1996-01-01' AND observed_at < TIMESTAMP '1999-01-01'""",
    ),
    "best_price": (best_price, _BEST_BOOK_SQL),
    "market_margin": (
        market_margin,
        f"SELECT event_id, implied_ppm, implied_ppm - 1000000 AS margin_ppm, is_arbitrage FROM ({_MARGIN_SQL}) m",
    ),
    "arbitrage": (arbitrage, f"SELECT event_id, implied_ppm FROM ({_MARGIN_SQL}) m WHERE is_arbitrage"),
    "line_movement": (line_movement, _MOVEMENT_SQL),
    "price_ranges": (
        price_ranges,
        f"SELECT selection_id, bookmaker, {_RANGE_COLS} FROM ({TICKS_SQL}) t WHERE decimal_odds IS NOT NULL GROUP BY 1, 2",
    ),
    "odds_bars": (
        odds_bars,
        f"""SELECT selection_id, bookmaker, date_trunc('hour', ts)::TIMESTAMP AS bar_start, {_RANGE_COLS}
          FROM ({TICKS_SQL}) t WHERE decimal_odds IS NOT NULL GROUP BY 1, 2, 3""",
    ),
    "odds_bars_sliding": (
        odds_bars_sliding,
        f"""SELECT selection_id, bookmaker, bar_start, max(decimal_odds) AS high_odds, min(decimal_odds) AS low_odds, count(*) AS n_quotes
          FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS bar_start
            FROM ({TICKS_SQL}) t, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE decimal_odds IS NOT NULL) GROUP BY 1, 2, 3""",
    ),
    "change_only_history": (
        change_only_history,
        f"""SELECT * EXCLUDE (rn, po, pa) FROM (SELECT *, row_number() OVER w AS rn, lag(decimal_odds) OVER w AS po, lag(is_available) OVER w AS pa
          FROM ({TICKS_SQL}) t WINDOW w AS (PARTITION BY selection_id, bookmaker ORDER BY ts, event_id))
          WHERE rn = 1 OR po IS DISTINCT FROM decimal_odds OR pa IS DISTINCT FROM is_available""",
    ),
    "quiet_sessions": (
        quiet_sessions,
        f"""SELECT bookmaker, min(ts) AS session_start, max(ts) AS last_quote, count(*) AS n_quotes FROM (
          SELECT *, sum(new) OVER (PARTITION BY bookmaker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY bookmaker ORDER BY ts, event_id) < INTERVAL 30 MINUTE
              THEN 0 ELSE 1 END AS new FROM ({TICKS_SQL}) t)) GROUP BY bookmaker, sid""",
    ),
    "observation_keys": (
        observation_keys,
        f"SELECT event_id, {_TICK_KEY_SQL} AS observation_key FROM ({TICKS_SQL}) t",
    ),
    "dedup_quotes": (
        dedup_quotes,
        f"""SELECT observation_key, event_id, decimal_odds, ts FROM (SELECT *, row_number() OVER (PARTITION BY observation_key ORDER BY ts, event_id) AS rn
          FROM (SELECT *, {_DAY_KEY_SQL} AS observation_key FROM ({TICKS_SQL}) t)) WHERE rn = 1""",
    ),
    "append_unseen": (
        append_unseen,
        f"""WITH k AS (SELECT *, {_DAY_KEY_SQL} AS observation_key FROM ({TICKS_SQL}) t)
          SELECT observation_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY observation_key ORDER BY ts, event_id) AS rn FROM k)
          WHERE rn = 1 AND observation_key NOT IN (SELECT observation_key FROM k WHERE ts < TIMESTAMP '2024-01-15')""",
    ),
    "freshness": (
        freshness,
        f"""SELECT bookmaker, max(observed_at) AS last_seen,
            CAST(epoch(TIMESTAMP '2002-01-01') - epoch(max(observed_at)) AS BIGINT) AS age_seconds,
            count(*) AS n_quotes, count(*) FILTER (NOT is_available) AS n_unavailable,
            CAST(floor(count(*) FILTER (NOT is_available) * 1000000 / count(*)) AS BIGINT) AS unavailable_ppm
          FROM ({QUOTES_SQL}) q GROUP BY bookmaker""",
    ),
    "alerts": (
        alerts,
        f"""WITH rules(rule_id, kind, threshold) AS (VALUES ('r1', 'price_move', 2000000), ('r2', 'price_move', 5000000),
            ('r3', 'arbitrage', 200000), ('r4', 'unavailable', 1)),
          changes AS (
            SELECT 'price_move' AS kind, concat(selection_id, '/', bookmaker) AS subject, CAST(event_id AS VARCHAR) AS "at",
              CAST(abs(step * 1000000) AS BIGINT) AS amount FROM ({_MOVEMENT_SQL}) m WHERE step IS NOT NULL
            UNION ALL SELECT 'arbitrage', event_id, 'latest', 1000000 - implied_ppm FROM ({_MARGIN_SQL}) a WHERE is_arbitrage
            UNION ALL SELECT 'unavailable', event_id, strftime(observed_at, '%Y-%m-%d'), count(*) FROM ({QUOTES_SQL}) q
              WHERE NOT is_available GROUP BY event_id, observed_at)
          SELECT rule_id, kind, subject, "at", amount FROM changes JOIN rules USING (kind) WHERE amount >= threshold""",
    ),
}

