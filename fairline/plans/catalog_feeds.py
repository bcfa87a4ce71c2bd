"""Registered queries of feed records other than markets: each row of a table becomes a payload, which the parsers read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.plans import views
from fairline.sources import keyed_feed, nested_feed
from fairline.sources.union import union_books

_BOOK = nested_feed.Book(id="x:7", name="Seven")
_SINCE = "1993-06-01 00:00:00"


def _payloads(rows: DataFrame, *document: str) -> DataFrame:
    return rows.select(F.to_json(F.expr(", ".join(document))).alias("payload"))


def feed_nested_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a schedule: wrapped or bare, named by its people, live or not, some without a time zone, sport or people."""
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    people = """filter(array(
        named_struct('id', concat('c', o_custkey), 'name', concat(' Club ', o_custkey), 'qualifier', 'home'),
        named_struct('id', CASE WHEN o_custkey % 4 = 0 THEN ' ' ELSE concat('c', o_custkey + 1) END, 'name', concat('Club ', o_custkey + 1), 'qualifier', 'away')),
        p -> o_custkey % 9 <> 0)"""
    sport = "CASE WHEN o_custkey % 7 <> 0 THEN named_struct('id', substring(o_orderpriority, 1, 1), 'name', 'x') END"
    start = f"concat({day}, CASE WHEN o_orderkey % 10 = 0 THEN 'T12:00:00' WHEN o_orderkey % 3 = 0 THEN 'T12:00:00+02:00' ELSE 'T12:00:00Z' END)"
    status = "CASE o_orderstatus WHEN 'F' THEN 'ENDED' WHEN 'O' THEN 'not_started' ELSE '1st_half' END"
    event = f"""named_struct('id', concat('e', o_orderkey), 'start_time', {start}, 'status', {status}, 'competitors', {people},
        'sport_event_context', named_struct('sport', {sport}, 'competition', named_struct('id', concat('k', o_custkey % 20), 'name', concat('League ', o_custkey % 20))))"""
    bare = f"""named_struct('id', concat('e', o_orderkey), 'scheduled', {start}, 'name', concat('Order ', o_orderkey), 'sport', {sport}, 'tournament', named_struct('id', concat('t', o_custkey % 20)))"""
    stamp = f"'generated_at', concat({day}, 'T08:30:00Z')"
    document = f"""CASE WHEN o_custkey % 2 = 0 THEN to_json(named_struct({stamp}, 'schedules', array(named_struct('sport_event', {event}))))
        ELSE to_json(named_struct({stamp}, 'sport_events', array({bare}))) END"""
    payloads = views.table(spark, folder, "orders").select(F.expr(document).alias("payload"))
    rows = nested_feed.events(payloads, _BOOK, since=F.lit(_SINCE).cast("timestamp"), sport_source_id="asked")
    return rows.select(
        "source_id", "sport_source_id", "competition_source_id", F.col("competition.name").alias("competition"), "name",
        F.array_join(F.transform("participants", lambda p: F.concat_ws("=", p["role"], p["source_id"])), ",").alias("people"),
        F.col("start_time").cast("timestamp_ntz").alias("start_time"), "status", "is_live",
        F.col("source_updated_at").cast("timestamp_ntz").alias("source_updated_at"),
    )


_NESTED_EVENTS_SQL = f"""
WITH e AS (
  SELECT *, o_custkey % 2 = 0 AS wrapped, o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 10 HOUR ELSE INTERVAL 12 HOUR END AS start_time,
    CASE WHEN NOT wrapped OR o_custkey % 9 = 0 THEN '' ELSE concat('home=c', o_custkey, CASE WHEN o_custkey % 4 <> 0 THEN concat(',away=c', o_custkey + 1) ELSE '' END) END AS people,
    CASE WHEN NOT wrapped THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'O' THEN 'scheduled' ELSE 'live' END AS status
  FROM orders WHERE o_orderkey % 10 <> 0
)
SELECT concat('e', o_orderkey) AS source_id, CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority[1] ELSE 'asked' END AS sport_source_id,
  concat(CASE WHEN wrapped THEN 'k' ELSE 't' END, o_custkey % 20) AS competition_source_id,
  CASE WHEN wrapped THEN concat('League ', o_custkey % 20) END AS competition,
  CASE WHEN NOT wrapped THEN concat('Order ', o_orderkey) WHEN people <> '' THEN concat('Club ', o_custkey, CASE WHEN o_custkey % 4 <> 0 THEN concat(' - Club ', o_custkey + 1) ELSE '' END) END AS name,
  people, CAST(start_time AS TIMESTAMP) AS start_time, status, status = 'live' AS is_live, CAST(o_orderdate + INTERVAL 510 MINUTE AS TIMESTAMP) AS source_updated_at
FROM e WHERE start_time >= TIMESTAMP '{_SINCE}'
"""


def feed_keyed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a fixture; only pregame ones of the book with two people and a named tournament are events."""
    document = """array(named_struct('fixtureId', concat('f', o_orderkey),
        'status', named_struct('live', o_orderstatus = 'P', 'statusId', CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END),
        'sport', named_struct('sportId', o_custkey % 5), 'season', named_struct('seasonName', date_format(o_orderdate, 'yyyy')),
        'tournament', named_struct('tournamentId', o_custkey % 20, 'tournamentName', CASE WHEN o_custkey % 20 <> 3 THEN concat('Cup ', o_custkey % 20) END),
        'startTime', unix_seconds(CAST(o_orderdate AS TIMESTAMP)),
        'participants', named_struct('participant1Id', o_custkey, 'participant1Name', concat('Club ', o_custkey),
          'participant2Id', CASE WHEN o_custkey % 8 <> 0 THEN o_custkey + 1 END, 'participant2Name', CASE WHEN o_orderkey % 3 <> 0 THEN concat('Club ', o_custkey + 1) END),
        'bookmakers', map('seven', named_struct('bookmaker', CASE WHEN o_orderkey % 13 = 0 THEN 'other' ELSE 'seven' END))))"""
    payloads = _payloads(views.table(spark, folder, "orders"), document)
    rows = keyed_feed.events(payloads, "seven", sport_source_id="2")
    return rows.select(
        "source_id", "sport_source_id", "competition_source_id", F.col("competition.name").alias("competition"),
        F.col("competition.season").alias("season"), "name", "status", F.col("start_time").cast("timestamp_ntz").alias("start_time"),
        F.array_join(F.transform("participants", lambda p: F.concat_ws("=", p["position"].cast("string"), p["source_id"])), ",").alias("people"),
    )


_KEYED_EVENTS_SQL = """
SELECT concat('f', o_orderkey) AS source_id, '2' AS sport_source_id, CAST(o_custkey % 20 AS VARCHAR) AS competition_source_id,
  concat('Cup ', o_custkey % 20) AS competition, strftime(o_orderdate, '%Y') AS season,
  CASE WHEN o_orderkey % 3 <> 0 THEN concat('Club ', o_custkey, ' - Club ', o_custkey + 1) END AS name, 'scheduled' AS status,
  CAST(o_orderdate AS TIMESTAMP) AS start_time, concat('1=', o_custkey, ',2=', o_custkey + 1) AS people
FROM orders
WHERE o_orderstatus <> 'P' AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_custkey % 5 = 2 AND o_custkey % 20 <> 3 AND o_custkey % 8 <> 0
"""


def feed_sports(spark: SparkSession, folder: str) -> DataFrame:
    """Every supplier as a sport in both feeds, as one set of records with the book's code."""
    suppliers = views.table(spark, folder, "supplier")
    nested = _payloads(suppliers, "named_struct('sports', array(named_struct('id', concat('s', s_suppkey), 'name', CASE WHEN s_suppkey % 6 <> 0 THEN s_name END, 'type', 'team')))")
    keyed = _payloads(suppliers, "array(named_struct('sportId', CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END, 'sportName', concat(' ', s_name), 'slug', s_name))")
    feeds = union_books({"nested": nested_feed.sports(nested, _BOOK), "keyed": keyed_feed.sports(keyed)})
    return feeds.select("bookmaker_code", "source_id", "name", F.coalesce(F.col("metadata")["provider_type"], F.col("metadata")["provider_slug"]).alias("detail"))


_SPORTS_SQL = """
SELECT 'nested' AS bookmaker_code, concat('s', s_suppkey) AS source_id, s_name AS name, 'team' AS detail FROM supplier WHERE s_suppkey % 6 <> 0
UNION ALL SELECT 'keyed', CAST(s_suppkey AS VARCHAR), s_name, s_name FROM supplier WHERE s_suppkey % 4 <> 0
"""


def feed_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a book is listed, for a book that a supplier stands for and one that none does."""
    suppliers = views.table(spark, folder, "supplier")
    nested = _payloads(suppliers, "named_struct('books', array(named_struct('id', concat('x:', s_suppkey), 'name', s_name)))")
    keyed = _payloads(suppliers, "array(named_struct('slug', concat('b', s_suppkey), 'active', s_suppkey % 2 = 1))")
    asked = {
        "nested known": nested_feed.coverage(nested, _BOOK), "nested unknown": nested_feed.coverage(nested, nested_feed.Book(id="x:0", name="none")),
        "keyed active": keyed_feed.coverage(keyed, "b7"), "keyed inactive": keyed_feed.coverage(keyed, "b8"),
    }
    return union_books(asked).select(F.col("bookmaker_code").alias("asked"), "healthy")


_COVERAGE_SQL = """
SELECT 'nested known' AS asked, bool_or(s_suppkey = 7) AS healthy FROM supplier UNION ALL SELECT 'nested unknown', bool_or(s_suppkey = 0) FROM supplier
UNION ALL SELECT 'keyed active', bool_or(s_suppkey = 7) FROM supplier UNION ALL SELECT 'keyed inactive', bool_or(s_suppkey = 8 AND s_suppkey % 2 = 1) FROM supplier
"""

QUERIES = {
    "feed_nested_events": (feed_nested_events, _NESTED_EVENTS_SQL),
    "feed_keyed_events": (feed_keyed_events, _KEYED_EVENTS_SQL),
    "feed_sports": (feed_sports, _SPORTS_SQL),
    "feed_coverage": (feed_coverage, _COVERAGE_SQL),
}
