"""Registered queries over feeds, markets, selections, runs and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions import keys
from fairline.functions.scalars import lenient_integer
from fairline.operators import quality, snapshots, structural
from fairline.plans import views
from fairline.plans.catalog_history import LATEST_SQL, latest_odds
from fairline.plans.catalog_identity import uuid5_sql
from fairline.plans.views import QUOTES_SQL
from fairline.sources import keyed_feed, nested_feed

_BOOK = nested_feed.Book(id="sr:book:7", name="Book Seven")

_ROW = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_PRICE = "CAST(CAST(1 + l_quantity / 10 AS DECIMAL(18,2)) AS {text})"


def _lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "lineitem")


def nested_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Every lineitem row as one nested market payload: three market kinds, removed books and
    outcomes, contradicting lines and a second book to be ignored."""
    rows = views.spread(_lineitem(spark, folder)).withColumn("row_id", F.expr(_ROW)).withColumn(
        "price", F.expr(_PRICE.format(text="STRING"))
    )
    line = F.expr("CAST(CAST(l_linenumber AS DECIMAL(4,1)) / 2 AS DECIMAL(4,1))")
    other = F.when(F.col("l_tax") > 0.06, line + 1).otherwise(line)
    kind = F.col("l_partkey") % 3

    def outcome(place: str, three_way: str, total: str, spread: str, sign: int, value: Column) -> Column:
        name = F.when(kind == 0, three_way).when(kind == 1, total).otherwise(spread)
        return F.struct(
            F.concat("row_id", F.lit(f"-{place}")).alias("external_outcome_id"),
            name.alias("type"),
            F.col("price").alias("odds_decimal"),
            F.when(kind == 1, value.cast("string")).alias("total"),
            F.when(kind == 2, (value * sign).cast("string")).alias("spread"),
            ((F.col("l_returnflag") == "R") & F.lit(place == "b")).alias("removed"),
        )

    outcomes = F.array(outcome("a", "Home", "Over", "HOME", -1, line), outcome("b", "Away", "Under", "away", 1, other))
    wanted = F.struct(
        F.lit("x:7").alias("id"), F.lit("Seven").alias("name"), F.col("row_id").alias("external_market_id"),
        (F.col("l_linestatus") == "F").alias("removed"), outcomes.alias("outcomes"),
    )
    ignored = F.struct(
        F.lit("x:8").alias("id"), F.lit("Eight").alias("name"), F.lit("no").alias("external_market_id"),
        F.lit(False).alias("removed"), outcomes.alias("outcomes"),
    )
    market = F.struct(
        F.when(F.col("l_suppkey") % 5 == 0, "sr:market:225").alias("id"),
        F.when(kind == 0, "3way").when(kind == 1, "total").otherwise("Spread").alias("name"),
        F.array(ignored, wanted).alias("books"),
    )
    document = F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
        F.struct(F.col("l_orderkey").cast("string").alias("id")).alias("sport_event"),
        F.array(market).alias("markets"),
    )
    return rows.select(F.to_json(document).alias("payload"))


def _flat(markets: DataFrame) -> DataFrame:
    return markets.select(
        "source_id", "event_source_id", "market_type", "period", F.col("line").alias("market_line"), "status",
        F.explode("selections").alias("s"),
    ).select(
        "source_id", "event_source_id", "market_type", "period", "market_line", "status",
        F.col("s.source_id").alias("selection_id"), F.col("s.label").alias("label"), F.col("s.selection_type").alias("selection_type"),
        F.col("s.participant_source_id").alias("participant_source_id"), F.col("s.line").alias("line"),
        F.col("s.price.decimal_odds").alias("decimal_odds"), F.col("s.price.is_available").alias("is_available"),
        F.col("s.price.source_updated_at").cast("timestamp_ntz").alias("source_updated_at"),
    )


def feed_nested_markets(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(nested_feed.markets(nested_payloads(spark, folder), _BOOK))


_NESTED_SQL = f"""
  SELECT source_id, event_source_id, CASE WHEN safe THEN type END AS market_type, CASE WHEN safe THEN 'full_time' END AS period,
    CASE WHEN safe THEN CASE type WHEN 'total' THEN line WHEN 'spread' THEN -line END END AS market_line, status,
    source_id || '-' || place AS selection_id,
    label, CASE WHEN safe THEN lower(label) END AS selection_type, CAST(NULL AS VARCHAR) AS participant_source_id,
    CASE WHEN type = 'moneyline' THEN NULL WHEN type = 'total' THEN v ELSE v * sign END AS line,
    CASE WHEN available THEN price END AS decimal_odds, available AS is_available, source_updated_at
  FROM (SELECT *, CASE kind WHEN 0 THEN 'moneyline' WHEN 1 THEN 'total' ELSE 'spread' END AS type,
      NOT unsupported AND (kind = 0 OR line = other) AS safe,
      CASE place WHEN 'a' THEN CASE kind WHEN 0 THEN 'Home' WHEN 1 THEN 'Over' ELSE 'HOME' END
        ELSE CASE kind WHEN 0 THEN 'Away' WHEN 1 THEN 'Under' ELSE 'away' END END AS label,
      CASE place WHEN 'a' THEN line ELSE other END AS v, CASE place WHEN 'a' THEN -1 ELSE 1 END AS sign,
      status = 'open' AND NOT (l_returnflag = 'R' AND place = 'b') AND price > 1 AS available
    FROM (SELECT {_ROW} AS source_id, CAST(l_orderkey AS VARCHAR) AS event_source_id, l_partkey % 3 AS kind, l_returnflag,
        l_suppkey % 5 = 0 AS unsupported, CAST(l_linenumber * 0.5 AS DECIMAL(18,8)) AS line,
        CAST(l_linenumber * 0.5 + CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END AS DECIMAL(18,8)) AS other,
        CASE WHEN l_linestatus = 'F' THEN 'suspended' ELSE 'open' END AS status,
        CAST({_PRICE.format(text="DECIMAL(18,8)")} AS DECIMAL(18,8)) AS price, l_shipdate AS source_updated_at,
        unnest(['a', 'b']) AS place FROM lineitem))
"""


def market_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Markets by type and whether their outcomes agree on one line."""
    return nested_feed.markets(nested_payloads(spark, folder), _BOOK).groupBy("name", "market_type").agg(
        F.count("*").alias("n_markets"), F.count("line").alias("n_lined"), F.sum("line").alias("line_total")
    )


_SLUG = "keyed"


def keyed_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Every lineitem row as one keyed odds document with a three-quote market."""
    rows = views.spread(_lineitem(spark, folder)).withColumn("row_id", F.expr(_ROW)).withColumn(
        "price", F.expr(_PRICE.format(text="STRING"))
    )

    def quote(outcome: int) -> Column:
        return F.struct(
            F.lit(_SLUG).alias("bookmaker"),
            F.when((F.col("l_linenumber") != 7) | F.lit(outcome != 2), F.lit(outcome)).alias("outcomeId"),
            F.col("price").alias("price"),
            (F.col("l_returnflag") != "R").alias("active"),
            F.when(F.col("l_tax") > 0.02, ~((F.col("l_discount") > 0.08) & F.lit(outcome == 3))).alias("marketActive"),
            F.col("l_partkey").alias("marketId"),
            F.concat(F.lit("m-"), "row_id").alias("bookmakerMarketId"),
            F.concat("row_id", F.lit(f"-{outcome}")).alias("bookmakerOutcomeId"),
            (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1000 + outcome).alias("bookmakerChangedAt"),
        )

    meta = F.struct(
        F.lit(_SLUG).alias("bookmaker"),
        (F.col("l_linestatus") == "F").alias("suspended"),
        (F.col("l_suppkey") % 10 == 0).alias("staleOdds"),
        F.when(F.col("l_suppkey") % 10 != 1, F.col("l_suppkey") % 10 == 2).alias("participantsRotated"),
    )
    document = F.struct(
        F.col("row_id").alias("fixtureId"),
        F.struct((F.col("l_quantity") > 45).alias("live"), F.lit(0).alias("statusId")).alias("status"),
        F.struct(F.col("l_suppkey").alias("participant1Id"), F.col("l_partkey").alias("participant2Id")).alias("participants"),
        F.create_map(F.lit(_SLUG), meta).alias("bookmakers"),
        F.create_map(
            F.lit(_SLUG),
            F.create_map(F.lit("o1"), quote(1), F.lit("o2"), quote(2), F.lit("o3"), quote(3)),
        ).alias("odds"),
    )
    return rows.select(F.to_json(document).alias("payload"))


def definition_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """part as the market-definition dimension: market id = part key."""
    named = F.array(
        *[F.struct(F.lit(i).alias("outcomeId"), F.lit(n).alias("outcomeName")) for i, n in ((1, "1"), (2, "x"), (3, "2"))]
    )
    definition = F.struct(
        F.col("p_partkey").alias("marketId"), F.when(F.col("p_size") < 30, "1X2").otherwise("totals").alias("marketType"),
        F.lit("Full-Time").alias("period"), (F.col("p_brand") == "Brand#1").alias("playerProp"),
        F.when(F.col("p_size") < 20, 0).alias("handicap"), F.col("p_name").alias("marketName"), named.alias("outcomes"),
    )
    return views.spread(views.table(spark, folder, "part")).select(F.to_json(F.array(definition)).alias("payload"))


def feed_keyed_markets(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(keyed_feed.markets(keyed_payloads(spark, folder), definition_payloads(spark, folder), _SLUG))


_KEYED_SQL = f"""
  SELECT 'm-' || row_id AS source_id, row_id AS event_source_id, CASE WHEN three_way THEN 'moneyline' END AS market_type,
    CASE WHEN three_way THEN 'full_time' END AS period, CAST(NULL AS DECIMAL(18,8)) AS market_line,
    CASE WHEN closed THEN 'suspended' ELSE 'open' END AS status, row_id || '-' || o AS selection_id,
    CASE WHEN p_partkey IS NULL THEN CAST(o AS VARCHAR) ELSE ['1', 'x', '2'][o] END AS label,
    CASE WHEN three_way THEN ['home', 'draw', 'away'][o] END AS selection_type,
    CASE WHEN three_way AND o = 1 THEN CAST(l_suppkey AS VARCHAR) WHEN three_way AND o = 3 THEN CAST(l_partkey AS VARCHAR) END AS participant_source_id,
    CAST(NULL AS DECIMAL(18,8)) AS line, CASE WHEN available THEN price END AS decimal_odds, available AS is_available,
    l_shipdate + o * INTERVAL 1 MILLISECOND AS source_updated_at
  FROM (SELECT *, NOT closed AND l_suppkey % 10 <> 0 AND l_returnflag <> 'R' AND price > 1 AS available FROM (
    SELECT *, {_ROW} AS row_id, unnest(CASE WHEN l_linenumber = 7 THEN [1, 3] ELSE [1, 2, 3] END) AS o,
      l_linestatus = 'F' OR (l_tax > 0.02 AND l_discount > 0.08) AS closed,
      coalesce(p_size < 30 AND p_brand <> 'Brand#1' AND l_suppkey % 10 NOT IN (1, 2), false) AS three_way,
      CAST({_PRICE.format(text="DECIMAL(18,8)")} AS DECIMAL(18,8)) AS price
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_quantity <= 45))
"""


def stale_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Stale, suspended and open markets with their available prices."""
    markets = keyed_feed.markets(keyed_payloads(spark, folder), definition_payloads(spark, folder), _SLUG)
    stale = F.coalesce(F.try_element_at("metadata", F.lit("stale_odds")) == "true", F.lit(False))
    return markets.groupBy("status", stale.alias("stale")).agg(
        F.count("*").alias("n_markets"),
        F.sum(F.size(F.filter("selections", lambda s: s["price"]["is_available"]))).alias("n_available"),
    )


def market_status(spark: SparkSession, folder: str) -> DataFrame:
    """A market is suspended when any of its quotes is inactive."""
    return views.quotes(spark, folder).groupBy("event_id", "bookmaker").agg(
        F.when(F.bool_or(~F.col("is_available")), "suspended").otherwise("open").alias("status"),
        F.count("*").alias("n_quotes"),
    )


def availability(spark: SparkSession, folder: str) -> DataFrame:
    """Prices kept only where the quote and its whole market are open; the quote itself stays."""
    rows = views.quotes(spark, folder)
    status = market_status(spark, folder).select("event_id", "bookmaker", "status")
    open_price = (F.col("status") == "open") & F.col("is_available") & (F.col("decimal_odds") > 1)
    return rows.join(status, ["event_id", "bookmaker"]).select(
        "event_id", "bookmaker", "seq", "pk", "sk", "observed_at",
        F.when(open_price, F.col("decimal_odds")).alias("decimal_odds"), F.coalesce(open_price, F.lit(False)).alias("is_available"),
    )


def feed_json_extract(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.from_json("props", "STRUCT<k:STRING,missing:STRING>")
    return views.table(spark, folder, "events").select(
        "event_id", lenient_integer(parsed["k"]).alias("k"), parsed["missing"].alias("missing")
    )


def snapshot_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One snapshot per event and book: a digest of its latest quote per outcome, whatever their order."""
    quote = F.struct(
        F.concat_ws(":", "selection_type", "seq", "pk").alias("source_id"), F.col("selection_type").alias("label"),
        "decimal_odds", "is_available", F.col("observed_at").cast("timestamp").alias("source_updated_at"),
    )
    # Three outcomes at most, so a market's list is small however often it was quoted.
    markets = latest_odds(spark, folder).groupBy("event_id", "bookmaker").agg(F.collect_list(quote).alias("selections"))
    rows = markets.select(
        F.col("bookmaker").alias("bookmaker_id"), F.col("event_id").alias("market_id"), F.lit("open").alias("status"),
        "selections", F.lit(None).cast("timestamp").alias("source_updated_at"),
    )
    return snapshots.with_snapshot(rows, F.lit("2026-01-01").cast("timestamp")).select(
        "market_id", "bookmaker_id", "snapshot_id", F.col("snapshot_time").cast("timestamp_ntz").alias("snapshot_time")
    )


_STATE_SQL = """concat_ws('|', concat_ws(':', selection_type, seq, pk),
    coalesce(regexp_replace(CAST(decimal_odds AS VARCHAR), '\\.?0+$', ''), ''), CASE WHEN is_available THEN '1' ELSE '0' END)"""
_SNAPSHOT_NAME = """bookmaker || '|' || event_id || '|' || strftime(seen, '%Y-%m-%dT%H:%M:%S.%f+00:00') || '|open|0|' || state"""
_SNAPSHOT_SQL = f"""
  SELECT event_id AS market_id, bookmaker AS bookmaker_id, {uuid5_sql(keys.SNAPSHOT_NAMESPACE, _SNAPSHOT_NAME)} AS snapshot_id, seen AS snapshot_time
  FROM (SELECT event_id, bookmaker, max(observed_at) AS seen, array_to_string(list_sort(list({_STATE_SQL})), ';') AS state
    FROM ({LATEST_SQL}) q GROUP BY 1, 2)
"""

_MARKET_TYPE = """CASE l_partkey % 6 WHEN 0 THEN 'Moneyline' WHEN 1 THEN 'TOTAL' WHEN 2 THEN 'spread' WHEN 3 THEN 'both teams-to score'
  WHEN 4 THEN 'total' ELSE 'corners' END"""
_MARKET_COLUMNS = f"""
  CAST(l_orderkey AS STRING) AS event_id, {_MARKET_TYPE} AS market_type,
  CASE WHEN l_tax > 0 THEN CASE l_suppkey % 2 WHEN 0 THEN 'Full Time' ELSE 'full_time' END END AS period,
  CASE WHEN l_discount > 0.07 THEN 'game' END AS scope, CAST(NULL AS STRING) AS variant,
  CASE WHEN l_partkey % 6 IN (1, 2, 4) OR l_tax > 0.07 THEN CAST(l_linenumber AS DECIMAL(18,8)) / CAST(2 AS DECIMAL(2,0)) END AS line
"""


def market_structural_match(spark: SparkSession, folder: str) -> DataFrame:
    """Every lineitem row as a source market; rows with flag A are also the stored markets."""
    _lineitem(spark, folder).createOrReplaceTempView("fairline_lineitem")
    sources = spark.sql(
        f"""SELECT 'book-x' AS bookmaker_id, {_ROW} AS source_id, struct(l_linenumber, l_partkey, l_suppkey) AS seq, {_MARKET_COLUMNS}
        FROM fairline_lineitem"""
    )
    stored = spark.sql(f"SELECT {_ROW} AS id, {_MARKET_COLUMNS} FROM fairline_lineitem WHERE l_returnflag = 'A'")
    return structural.match_markets(sources, stored).select("source_id", "state", "reason_code", "canonical_id")


def _structural_sql(rows: str, stored: str, key: list[str], entity_type: str) -> str:
    same = lambda a, b: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in key)
    columns = ", ".join(key)
    made = uuid5_sql(keys.CANONICAL_NAMESPACE, f"'book-x:{entity_type}:' || k.source_id")
    return f"""
      WITH stored AS (SELECT {columns}, count(*) AS n, min(id) AS stored_id FROM ({stored}) GROUP BY {columns}),
        judged AS (SELECT s.*, stored_id, CASE WHEN NOT complete THEN 'unresolved' WHEN n > 1 THEN 'rejected' WHEN n = 1 THEN 'matched'
          ELSE 'created' END AS verdict FROM ({rows}) s LEFT JOIN stored c ON {same("s", "c")}),
        creators AS (SELECT {columns}, arg_min(source_id, seq) AS source_id FROM judged WHERE verdict = 'created' GROUP BY {columns})
      SELECT s.source_id, state, CASE state WHEN 'unresolved' THEN 'incomplete_semantics' WHEN 'rejected' THEN 'data_integrity_duplicate_key'
          WHEN 'matched' THEN 'structural_match' ELSE 'no_structural_match' END AS reason_code, canonical_id FROM (
        SELECT s.source_id, CASE WHEN verdict = 'created' AND k.source_id <> s.source_id THEN 'matched' ELSE verdict END AS state,
          CASE verdict WHEN 'matched' THEN stored_id WHEN 'created' THEN {made} END AS canonical_id
        FROM judged s LEFT JOIN creators k ON {same("s", "k")}) s
    """


_MARKET_NORMAL = """SELECT * REPLACE (trim(regexp_replace(lower(market_type), '[^a-z0-9_]+', '_', 'g'), '_') AS market_type,
    trim(regexp_replace(lower(period), '[^a-z0-9_]+', '_', 'g'), '_') AS period) FROM"""
_MARKET_ROWS_SQL = f"""
  SELECT *, coalesce(period IS NOT NULL AND ((market_type IN ('moneyline', 'both_teams_to_score') AND line IS NULL)
    OR (market_type IN ('spread', 'total') AND line IS NOT NULL)), false) AS complete FROM ({_MARKET_NORMAL} (
      SELECT {_ROW} AS source_id, (l_linenumber, l_partkey, l_suppkey) AS seq, {_MARKET_COLUMNS.replace('STRING', 'VARCHAR')} FROM lineitem))
"""
_MARKET_STORED_SQL = f"{_MARKET_NORMAL} (SELECT {_ROW} AS id, {_MARKET_COLUMNS.replace('STRING', 'VARCHAR')} FROM lineitem WHERE l_returnflag = 'A')"

_SELECTION_COLUMNS = """
  CAST(l_orderkey AS STRING) AS market_id, CAST(l_orderkey AS STRING) AS event_id,
  CASE l_partkey % 8 WHEN 0 THEN 'Home' WHEN 1 THEN 'away' WHEN 2 THEN 'draw' WHEN 3 THEN 'Over' WHEN 4 THEN 'under' WHEN 5 THEN 'yes'
    WHEN 6 THEN 'participant' ELSE 'weird' END AS selection_type,
  CASE WHEN l_suppkey % 2 = 0 THEN concat('p', CAST(l_suppkey % 4 AS STRING)) END AS participant_id,
  CASE WHEN l_discount > 0.02 THEN CAST(l_linenumber AS DECIMAL(18,8)) END AS line,
  CASE WHEN l_tax > 0.01 THEN CAST(l_linenumber + CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END AS DECIMAL(18,8)) END AS market_line
"""


def selection_structural_match(spark: SparkSession, folder: str) -> DataFrame:
    """Every lineitem row as a source selection; missing sides come from the event's unique roles."""
    _lineitem(spark, folder).createOrReplaceTempView("fairline_lineitem")
    sources = spark.sql(
        f"""SELECT 'book-x' AS bookmaker_id, {_ROW} AS source_id, struct(l_linenumber, l_partkey, l_suppkey) AS seq, {_SELECTION_COLUMNS}
        FROM fairline_lineitem"""
    )
    stored = spark.sql(f"SELECT {_ROW} AS id, {_SELECTION_COLUMNS} FROM fairline_lineitem WHERE l_returnflag = 'A'")
    orders = views.table(spark, folder, "orders")
    people = orders.select(
        F.col("o_orderkey").cast("string").alias("event_id"),
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("c"), "o_custkey").alias("participant_id"), F.lit("HOME").alias("role")),
                F.struct(F.lit("guest").alias("participant_id"), F.when(F.col("o_orderstatus") == "O", "home").otherwise("Away").alias("role")),
            )
        ).alias("p"),
    ).select("event_id", "p.participant_id", "p.role")
    return structural.match_selections(sources, stored, people).select("source_id", "state", "reason_code", "canonical_id")


_SIDES_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS eid, CASE WHEN o_orderstatus <> 'O' THEN concat('c', o_custkey) END AS home,
    CASE WHEN o_orderstatus <> 'O' THEN 'guest' END AS away FROM orders"""
_SELECTION_SQL_COLUMNS = _SELECTION_COLUMNS.replace("STRING", "VARCHAR")
_SELECTION_ROWS_SQL = f"""
  SELECT *, CASE WHEN selection_type IN ('home', 'away', 'participant') THEN participant_id IS NOT NULL
      WHEN selection_type IN ('draw', 'yes') THEN true WHEN selection_type IN ('over', 'under')
      THEN effective_line IS NOT NULL AND coalesce(line = market_line, true) ELSE false END AS complete
  FROM (SELECT source_id, seq, market_id, lower(selection_type) AS selection_type, line, market_line,
      CASE WHEN lower(selection_type) = 'home' THEN coalesce(participant_id, home) WHEN lower(selection_type) = 'away'
        THEN coalesce(participant_id, away) ELSE participant_id END AS participant_id,
      CASE WHEN lower(selection_type) IN ('over', 'under') THEN coalesce(line, market_line) ELSE line END AS effective_line
    FROM (SELECT {_ROW} AS source_id, (l_linenumber, l_partkey, l_suppkey) AS seq, {_SELECTION_SQL_COLUMNS} FROM lineitem) s
    LEFT JOIN ({_SIDES_SQL}) o ON o.eid = s.event_id)
"""
_SELECTION_STORED_SQL = f"""
  SELECT id, market_id, lower(selection_type) AS selection_type, participant_id,
    CASE WHEN lower(selection_type) IN ('over', 'under') THEN coalesce(line, market_line) ELSE line END AS effective_line
  FROM (SELECT {_ROW} AS id, {_SELECTION_SQL_COLUMNS} FROM lineitem WHERE l_returnflag = 'A')
"""


def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Structural keys held by more than one stored market."""
    _lineitem(spark, folder).createOrReplaceTempView("fairline_lineitem")
    stored = spark.sql(f"SELECT {_ROW} AS id, {_MARKET_COLUMNS} FROM fairline_lineitem")
    return structural.duplicate_keys(structural.normalized_markets(stored), structural.MARKET_KEY)


def _accepted_orders(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").cast("string").alias("event_id")
    )


def identity_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Per book: quotes of accepted events and quotes held back."""
    rows = views.quotes(spark, folder).groupBy("bookmaker", "event_id").agg(F.count("*").alias("n"))
    gated = rows.join(_accepted_orders(spark, folder).withColumn("ok", F.lit(True)), "event_id", "left")
    return gated.groupBy("bookmaker").agg(
        F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("passed"),
        F.sum(F.when(F.col("ok").isNull(), F.col("n")).otherwise(0)).alias("held_back"),
    )


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Run counters of one pass over all orders and their quotes, duplicates appended once."""
    orders = views.table(spark, folder, "orders").agg(
        F.count_if(F.col("o_orderstatus") != "P").alias("events"), F.count_if(F.col("o_orderstatus") == "P").alias("skipped")
    )
    rows = views.quotes(spark, folder).join(_accepted_orders(spark, folder), "event_id", "left_semi")
    series = rows.groupBy("event_id", "bookmaker", "selection_type").agg(
        F.count_distinct("decimal_odds", "is_available", "observed_at").alias("priced"),
        F.count_distinct(F.when(F.col("decimal_odds").isNull(), F.col("observed_at"))).alias("unpriced"),
    )
    markets = series.groupBy("event_id", "bookmaker").agg(
        F.count("*").alias("selections"), F.sum(F.col("priced") + F.col("unpriced")).alias("quotes")
    )
    counted = markets.agg(
        F.count("*").alias("markets"), F.sum("selections").alias("selections"), F.sum("quotes").alias("appended")
    )
    result = quality.run_counters(F.col("events"), F.col("skipped"), F.col("markets"), F.col("selections"), F.col("appended"))
    totals = orders.unionByName(counted, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("events", "skipped", "markets", "selections", "appended")]
    )
    return totals.select("events", "skipped", "markets", "selections", result.alias("r")).select(
        "events", "skipped", "markets", "selections", "r.received_count", "r.accepted_count", "r.rejected_count", "r.status"
    )


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """Contract rules over all quotes, one pass."""
    orders = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"), F.lit(True).alias("known")
    )
    rows = views.quotes(spark, folder).join(orders, "event_id", "left")
    return quality.report(
        rows,
        {
            "bookmaker_id": quality.bad_id(F.col("bookmaker")),
            "price": quality.bad_price(F.col("decimal_odds"), F.col("is_available")),
            "unknown_event": F.col("known").isNull(),
            "long_odds": F.col("decimal_odds") > 5,
        },
    )


def feed_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Contract report of the parsed nested feed."""
    return quality.report(nested_feed.markets(nested_payloads(spark, folder), _BOOK), quality.market_rules())


def operation_metrics(spark: SparkSession, folder: str) -> DataFrame:
    k = F.from_json("props", "STRUCT<k:INT>")["k"]
    metrics = views.table(spark, folder, "events").select(
        F.concat(F.lit("book-"), (F.col("user_id") % 5).cast("string")).alias("bookmaker"), F.col("event_type").alias("operation"),
        (1 + k % 3).cast("bigint").alias("attempts"), F.floor("value").cast("bigint").alias("latency_ms"),
        k.cast("bigint").alias("rate_limit_wait_ms"), F.when(k > 90, "timeout").alias("error"),
    )
    return quality.operation_metrics(metrics)


QUERIES = {
    "feed_nested_markets": (feed_nested_markets, _NESTED_SQL),
    "market_lines": (
        market_lines,
        f"""SELECT CASE WHEN type = 'moneyline' THEN '3way' WHEN type = 'total' THEN 'total' ELSE 'Spread' END AS name, market_type,
            count(*) AS n_markets, count(market_line) AS n_lined, sum(market_line) AS line_total
          FROM (SELECT *, CASE WHEN label IN ('Home', 'Away') THEN 'moneyline' WHEN label IN ('Over', 'Under') THEN 'total' ELSE 'spread' END AS type
            FROM ({_NESTED_SQL})) WHERE selection_id LIKE '%-a' GROUP BY 1, 2""",
    ),
    "feed_keyed_markets": (feed_keyed_markets, _KEYED_SQL),
    "stale_overlay": (
        stale_overlay,
        f"""SELECT status, stale, count(DISTINCT source_id) AS n_markets, count(*) FILTER (is_available) AS n_available
          FROM (SELECT *, CAST(string_split(event_source_id, '-')[4] AS BIGINT) % 10 = 0 AS stale FROM ({_KEYED_SQL})) GROUP BY 1, 2""",
    ),
    "market_status": (
        market_status,
        f"""SELECT event_id, bookmaker, CASE WHEN bool_or(NOT is_available) THEN 'suspended' ELSE 'open' END AS status, count(*) AS n_quotes
          FROM ({QUOTES_SQL}) q GROUP BY 1, 2""",
    ),
    "availability": (
        availability,
        f"""SELECT event_id, bookmaker, seq, pk, sk, observed_at, CASE WHEN ok THEN decimal_odds END AS decimal_odds, coalesce(ok, false) AS is_available
          FROM (SELECT *, bool_and(is_available) OVER (PARTITION BY event_id, bookmaker) AND decimal_odds > 1 AS ok FROM ({QUOTES_SQL}) q)""",
    ),
    "feed_json_extract": (
        feed_json_extract,
        "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events",
    ),
    "snapshot_ids": (snapshot_ids, _SNAPSHOT_SQL),
    "market_structural_match": (
        market_structural_match, _structural_sql(_MARKET_ROWS_SQL, _MARKET_STORED_SQL, structural.MARKET_KEY, "market")
    ),
    "selection_structural_match": (
        selection_structural_match,
        _structural_sql(_SELECTION_ROWS_SQL, _SELECTION_STORED_SQL, structural.SELECTION_KEY, "selection"),
    ),
    "duplicate_keys": (
        duplicate_keys,
        f"""SELECT event_id, market_type, period, scope, CAST(line AS DECIMAL(18,8)) AS line, variant, count(*) AS n FROM ({_MARKET_NORMAL} (
          SELECT {_MARKET_COLUMNS.replace('STRING', 'VARCHAR')} FROM lineitem)) GROUP BY ALL HAVING count(*) > 1""",
    ),
    "identity_gate": (
        identity_gate,
        f"""SELECT bookmaker, count(*) FILTER (o_orderstatus <> 'P') AS passed, count(*) FILTER (coalesce(o_orderstatus, 'P') = 'P') AS held_back
          FROM ({QUOTES_SQL}) q LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = event_id GROUP BY 1""",
    ),
    "run_summary": (
        run_summary,
        f"""WITH k AS (SELECT q.* FROM ({QUOTES_SQL}) q JOIN orders ON CAST(o_orderkey AS VARCHAR) = event_id AND o_orderstatus <> 'P'),
            c AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT event_id, bookmaker FROM k)) AS markets,
              (SELECT count(*) FROM (SELECT DISTINCT event_id, bookmaker, selection_type FROM k)) AS selections,
              (SELECT count(*) FROM (SELECT DISTINCT event_id, bookmaker, selection_type, decimal_odds, is_available, observed_at FROM k)) AS quotes,
              (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS events, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS skipped)
          SELECT events, skipped, markets, selections, events + skipped + markets + selections AS received_count, quotes AS accepted_count,
            skipped AS rejected_count, CASE WHEN skipped > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM c""",
    ),
    "quality_report": (
        quality_report,
        f"""SELECT rule, checked, broken FROM (SELECT count(*) AS checked, count(*) FILTER (bookmaker <> trim(bookmaker)) AS bookmaker_id,
            count(*) FILTER (is_available AND coalesce(decimal_odds <= 1, true)) AS price, count(*) FILTER (o_orderkey IS NULL) AS unknown_event,
            count(*) FILTER (decimal_odds > 5) AS long_odds FROM ({QUOTES_SQL}) q LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = event_id)
          UNPIVOT (broken FOR rule IN (bookmaker_id, price, unknown_event, long_odds))""",
    ),
    "feed_contract": (
        feed_contract,
        """SELECT unnest(['market_id', 'event_id', 'selection_id', 'price']) AS rule, count(*) AS checked, 0 AS broken FROM lineitem""",
    ),
    "operation_metrics": (
        operation_metrics,
        """SELECT concat('book-', user_id % 5) AS bookmaker, event_type AS operation, count(*) AS n_operations,
            CAST(sum(1 + k % 3) AS BIGINT) AS attempts, CAST(sum(k % 3) AS BIGINT) AS retries, count(*) FILTER (k > 90) AS errors,
            CAST(sum(k) AS BIGINT) AS rate_limit_wait_ms, max(ms) AS max_latency_ms, quantile_disc(ms, 0.95) AS p95_latency_ms
          FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS ms FROM events) GROUP BY 1, 2""",
    ),
}
