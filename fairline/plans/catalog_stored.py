"""Registered queries over stored tables, shared market identity, aliases and large name sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions import keys
from fairline.operators import structural
from fairline.operators.matching import match_names
from fairline.operators.resolve import resolve_names
from fairline.operators.rules import PARTICIPANT
from fairline.plans import readmodels, views
from fairline.plans.catalog_identity import _ladder_sql, _units_sql, normalized_sql, similarity_sql, uuid5_sql
from fairline.plans.views import PARTICIPANT_ENTITIES_SQL, PARTICIPANT_SOURCES_SQL
from fairline.schemas import TABLES
from fairline.storage import Store
from fairline.streaming.quotes import new_folder

_ROW = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_LINE = "CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_partkey % 3 AS DECIMAL(18,8)) + CAST(0.5 AS DECIMAL(18,8)) END"
_SIDE = "CASE WHEN l_linenumber % 2 = 1 THEN 'over' ELSE 'under' END"
_ODDS = "CAST(1 + CAST(l_quantity AS DECIMAL(18,8)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(18,8))"
_LIMITS = ("920000000000000000", "94/100", "80000000000000000", "780000000000000000")


def _shared_totals(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as the totals of two books, each row one side of a market: markets and selections are one where their keys agree."""
    rows = views.table(spark, folder, "lineitem").select(
        F.concat(F.lit("book-"), (F.col("l_suppkey") % 2).cast("string")).alias("bookmaker_id"), F.expr(_ROW).alias("source_id"),
        F.col("l_orderkey").cast("string").alias("event_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        F.lit("Total").alias("market_type"), F.lit("Full Time").alias("period"), *[F.lit(None).cast("string").alias(c) for c in ("scope", "variant")],
        F.expr(f"CAST({_LINE} AS DECIMAL(18,8))").alias("line"), F.expr(_SIDE).alias("side"), F.expr(_ODDS).alias("decimal_odds"),
        (F.col("l_returnflag") != "R").alias("is_available"), F.col("l_shipdate").alias("observed_at"),
    )
    # Files of columns take a small part of what checkpointed rows do; what an earlier step wrote goes when the next has been written.
    store = new_folder(spark, "shared-totals")
    nothing = spark.createDataFrame([], "id string, event_id string, market_type string, period string, scope string, line decimal(18,8), variant string")
    markets = structural.match_markets(rows, nothing, lambda df: _written(df, f"{store}/sources")).filter("canonical_id IS NOT NULL")
    asked = markets.select(
        "bookmaker_id", "source_id", "seq", _bytes(F.col("canonical_id")).alias("market_id"), "event_id", F.col("side").alias("selection_type"),
        F.lit(None).cast("string").alias("participant_id"), F.lit(None).cast("decimal(18,8)").alias("line"), F.col("line").alias("market_line"),
        *[F.col(c).alias(f"m_{c}") for c in structural.MARKET_KEY], "decimal_odds", "is_available", "observed_at",
    )
    none = spark.createDataFrame([], "id string, market_id binary, selection_type string, participant_id string, line decimal(18,8), market_line decimal(18,8)")
    members = spark.createDataFrame([], TABLES["event_participants"])
    matched = structural.match_selections(asked, none, members, lambda df: _written(df, f"{store}/asked", f"{store}/sources"))
    kept = matched.filter("canonical_id IS NOT NULL").withColumn("canonical_id", _bytes(F.col("canonical_id"))).drop("seq", "event_id")
    return _written(kept, f"{store}/matched", f"{store}/asked")


def _bytes(derived_id: Column) -> Column:
    """The 16 bytes of a derived id, for ids that only meet each other: less than half of their text."""
    return F.unhex(F.replace(derived_id, F.lit("-"), F.lit("")))


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, folder: str, done: str | None = None) -> DataFrame:
    """The rows, from files; what was shuffled for them goes, as do the files of the folder they were made from, ``done``."""
    spark = df.sparkSession
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)
    if done is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(done)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.schema(df.schema).parquet(folder)


def _shared_prices(spark: SparkSession, folder: str) -> DataFrame:
    rows = _shared_totals(spark, folder)
    quotes = rows.select("bookmaker_id", F.col("canonical_id").alias("selection_id"), "decimal_odds", "is_available", "observed_at", "source_id")
    selections = rows.select(F.col("canonical_id").alias("id"), "market_id", "selection_type", "participant_id", F.col("effective_line").alias("line")).distinct()
    markets = rows.select(F.col("market_id").alias("id"), *[F.col(f"m_{c}").alias(c) for c in structural.MARKET_KEY]).distinct()
    members = spark.createDataFrame([], TABLES["event_participants"])
    return readmodels.structural_prices(quotes, selections, markets, members, ["observed_at", "source_id"])


def two_book_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Best price of each side of each total over two books, by event and line."""
    return _shared_prices(spark, folder).select("event_id", "line", "selection_type", "best_odds", "best_book", "price_spread", "n_books")


def two_book_arbitrage(spark: SparkSession, folder: str) -> DataFrame:
    """Margin of every total that both sides of have a price, the line being part of the market."""
    best = _shared_prices(spark, folder)
    return readmodels.market_margin(best, ["event_id", "line"], "selection_type", ["over", "under"])


_TWO_BOOK_SQL = f"""
  SELECT event_id, line, selection_type, max(odds) AS best_odds, arg_min(book, (-odds, book)) AS best_book,
    CAST(max(odds) - min(odds) AS DECIMAL(18,8)) AS price_spread, count(*) AS n_books
  FROM (
    SELECT event_id, line, selection_type, book, arg_max(odds, (seen, row_id)) AS odds, arg_max(available, (seen, row_id)) AS available FROM (
      SELECT concat('book-', CAST(l_suppkey % 2 AS VARCHAR)) AS book, CAST(l_orderkey AS VARCHAR) AS event_id, CAST({_LINE} AS DECIMAL(18,8)) AS line,
        {_SIDE} AS selection_type, {_ODDS} AS odds, l_returnflag <> 'R' AS available, l_shipdate AS seen, {_ROW} AS row_id
      FROM lineitem WHERE l_partkey % 4 <> 0)
    GROUP BY ALL)
  WHERE available GROUP BY ALL
"""
_TWO_BOOK_MARGIN_SQL = f"""
  SELECT event_id, line, ppm AS implied_ppm, ppm - 1000000 AS margin_ppm, (a + b) * 100000000 < a * b AS is_arbitrage
  FROM (SELECT *, CAST((100000000000000000000000000::HUGEINT // a + 100000000000000000000000000::HUGEINT // b + 1) // 1000000000000 AS BIGINT) AS ppm FROM (
    SELECT event_id, line, CAST(max(best_odds) FILTER (selection_type = 'over') * 100000000 AS HUGEINT) AS a,
      CAST(max(best_odds) FILTER (selection_type = 'under') * 100000000 AS HUGEINT) AS b FROM ({_TWO_BOOK_SQL}) GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL)
"""


_START, _END = "1994-12-15", "1996-03-02"


def stored_quotes(spark: SparkSession, folder: str) -> Store:
    """A store with lineitem as its quotes, seen on the first of their months; every third has no source time."""
    store = Store(spark, new_folder(spark, "history"))
    rows = views.table(spark, folder, "lineitem").withColumn("row", F.expr(_ROW)).withColumn("at", F.trunc("l_shipdate", "MM").cast("timestamp"))
    seen = F.when(F.col("l_linenumber") % 3 != 0, F.col("at"))
    store.append(
        "odds_quotes",
        rows.select(
            F.col("row").alias("id"), F.lit("snapshot").alias("snapshot_id"), F.concat(F.lit("book-"), (F.col("l_suppkey") % 7).cast("string")).alias("bookmaker_id"),
            F.col("l_partkey").cast("string").alias("selection_id"), F.expr(_ODDS).alias("decimal_odds"), F.lit(True).alias("is_available"),
            F.col("at").alias("observed_at"), seen.alias("source_updated_at"), F.col("row").alias("observation_key"),
        ),
    )
    return store


def stored_history(spark: SparkSession, folder: str) -> DataFrame:
    """History of one book over some weeks, from stored quotes of which only those days are read."""
    store = stored_quotes(spark, folder)
    parts = views.table(spark, folder, "part")
    selections = parts.select(
        F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 100).cast("string").alias("market_id"), F.col("p_brand").alias("selection_type"),
        F.lit(None).cast("string").alias("participant_id"),
    )
    markets = parts.select(
        (F.col("p_partkey") % 100).cast("string").alias("id"), (F.col("p_partkey") % 10).cast("string").alias("event_id"), F.lit("total").alias("market_type"),
        F.lit("full_time").alias("period"), F.lit(None).cast("decimal(18,8)").alias("line"),
    ).distinct()
    at = lambda text: F.lit(text).cast("timestamp")
    rows = readmodels.quote_history(store.read("odds_quotes"), selections, markets, event_id="3", bookmaker_id="book-2", start=at(_START), end=at(_END))
    return rows.select("id", "selection_id", "market_id", "event_id", "selection_type", "decimal_odds", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


_HISTORY_SQL = f"""
  SELECT {_ROW} AS id, CAST(l_partkey AS VARCHAR) AS selection_id, CAST(l_partkey % 100 AS VARCHAR) AS market_id, '3' AS event_id,
    p_brand AS selection_type, {_ODDS} AS decimal_odds, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS observed_at
  FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_suppkey % 7 = 2 AND l_partkey % 10 = 3 AND date_trunc('month', l_shipdate) >= TIMESTAMP '{_START}' AND date_trunc('month', l_shipdate) < TIMESTAMP '{_END}'
"""


def alias_match(spark: SparkSession, folder: str) -> DataFrame:
    """Participants matched against canonical names and the reversed spellings learned as their aliases."""
    entities = views.participant_entities(spark, folder)
    aliases = entities.select(F.col("id").alias("entity_id"), F.concat(F.lit("zz"), F.reverse("name")).alias("alias"))
    decided = match_names(views.participant_sources(spark, folder), entities, aliases, PARTICIPANT)
    return decided.select("source_id", "state", "reason_code", "canonical_id", "best_units", "plausible_candidate_count")


_ALIAS_SCORED_SQL = f"""
  SELECT source_id, id, arg_max(num, score) AS num, arg_max(den, score) AS den, max(score) AS score FROM (
    SELECT source_id, id, num, den, {_units_sql("800 * num + (CASE WHEN participant_type = 'team' THEN 150 ELSE 75 END + 25) * den", "1000 * den")} AS score
    FROM ({similarity_sql(f'''SELECT s.source_id, s.participant_type, c.id, {normalized_sql("s.name")} AS a, {normalized_sql("c.name")} AS b
      FROM ({PARTICIPANT_SOURCES_SQL}) s JOIN (
        SELECT id, sport_id, name FROM ({PARTICIPANT_ENTITIES_SQL}) e UNION ALL SELECT id, sport_id, 'zz' || reverse(name) FROM ({PARTICIPANT_ENTITIES_SQL}) e2
      ) c ON s.sport_id = c.sport_id''')}))
  GROUP BY source_id, id
"""
_ALIAS_COUNTS_SQL = f"""
  SELECT s.source_id, 0 AS candidate_count, coalesce(p.n, 0) AS plausible_candidate_count, 0 AS hard_rejection_count FROM ({PARTICIPANT_SOURCES_SQL}) s
  LEFT JOIN (SELECT source_id, count(*) AS n FROM ({_ALIAS_SCORED_SQL}) x WHERE score >= 780000000000000000 GROUP BY 1) p ON p.source_id = s.source_id
"""
_ALIAS_SQL = f"""
  SELECT source_id, state, reason_code, canonical_id, best_units, plausible_candidate_count
  FROM ({_ladder_sql(_ALIAS_SCORED_SQL, _ALIAS_COUNTS_SQL, (5, 8), _LIMITS)})
"""


def _spelled(key: Column) -> Column:
    digest = F.md5(F.concat(F.lit("p"), key.cast("string")))
    return F.concat_ws(" ", F.substring(digest, 1, 5), F.substring(digest, 6, 5))


def name_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """All customers as one batch of participants, no two with one name, against entities that half of them resemble."""
    customers = views.table(spark, folder, "customer")
    key, known = F.col("c_custkey"), F.col("c_custkey") % 6 == 0
    sources = customers.select(
        F.lit("book-n").alias("bookmaker_id"), key.cast("string").alias("source_id"), F.col("c_mktsegment").alias("sport_id"), _spelled(key).alias("name"),
        F.when(known, "team").alias("participant_type"), F.when(known, "IT").alias("country_code"), key.cast("string").alias("event_key"),
        key.cast("bigint").alias("event_seq"), F.lit(0).alias("ordinal"), F.lit(True).alias("open"),
    )
    entities = customers.filter("c_custkey % 2 = 0").select(
        F.lpad(key.cast("string"), 12, "0").alias("id"), F.col("c_mktsegment").alias("sport_id"),
        F.when(known, _spelled(key)).otherwise(F.concat(F.lit("z"), F.substring(_spelled(key), 2, 20))).alias("name"),
        F.when(known, "team").alias("participant_type"), F.when(known, "IT").alias("country_code"),
    )
    result = resolve_names(
        sources, entities, None, spark.createDataFrame([], TABLES["source_entity_mappings"]), spark.createDataFrame([], TABLES["match_decisions"]), PARTICIPANT
    )
    return result.outcomes.select("source_id", "state", "reason_code", "canonical_id")


_SPELLED_SQL = "concat(substring(md5('p' || CAST(c_custkey AS VARCHAR)), 1, 5), ' ', substring(md5('p' || CAST(c_custkey AS VARCHAR)), 6, 5))"
_RESOLUTION_SCORED_SQL = f"""
  SELECT source_id, id, num, den, {_units_sql("800 * num + (CASE WHEN known AND other THEN 200 ELSE 100 END) * den", "1000 * den")} AS score
  FROM ({similarity_sql(f'''SELECT CAST(s.c_custkey AS VARCHAR) AS source_id, lpad(CAST(c.c_custkey AS VARCHAR), 12, '0') AS id, s.c_custkey % 6 = 0 AS known,
      c.c_custkey % 6 = 0 AS other, s.name AS a, CASE WHEN c.c_custkey % 6 = 0 THEN c.name ELSE 'z' || substring(c.name, 2) END AS b
    FROM (SELECT *, {_SPELLED_SQL} AS name FROM customer) s JOIN (SELECT *, {_SPELLED_SQL} AS name FROM customer WHERE c_custkey % 2 = 0) c
      ON s.c_mktsegment = c.c_mktsegment''')})
"""
_RESOLUTION_COUNTS_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS source_id, 0 AS candidate_count, 0 AS plausible_candidate_count, 0 AS hard_rejection_count FROM customer"
_RESOLUTION_SQL = f"""
  SELECT source_id, state, reason_code, CASE state WHEN 'matched' THEN canonical_id
    WHEN 'created' THEN {uuid5_sql(keys.CANONICAL_NAMESPACE, "'book-n:participant:' || source_id")} END AS canonical_id
  FROM ({_ladder_sql(_RESOLUTION_SCORED_SQL, _RESOLUTION_COUNTS_SQL, (0, 1), _LIMITS)})
"""


def skipped_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of received records that runs of a book had to skip, orders standing for runs."""
    runs = views.table(spark, folder, "orders").select(
        (F.col("o_custkey") % 7).cast("string").alias("bookmaker_id"), (F.col("o_orderkey") % 50 + 1).cast("bigint").alias("received_count"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(F.col("o_orderkey") % 3).cast("bigint").alias("rejected_count"),
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded").alias("status"),
    )
    return readmodels.skipped_share(runs)


QUERIES = {
    "two_book_prices": (two_book_prices, _TWO_BOOK_SQL),
    "two_book_arbitrage": (two_book_arbitrage, _TWO_BOOK_MARGIN_SQL),
    "stored_history": (stored_history, _HISTORY_SQL),
    "alias_match": (alias_match, _ALIAS_SQL),
    "name_resolution": (name_resolution, _RESOLUTION_SQL),
    "skipped_share": (
        skipped_share,
        """SELECT CAST(o_custkey % 7 AS VARCHAR) AS bookmaker_id, count(*) AS n_runs, CAST(sum(o_orderkey % 50 + 1) AS BIGINT) AS received_count,
            CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 3 END) AS BIGINT) AS skipped_count,
            CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 3 END) * 1000000 // sum(o_orderkey % 50 + 1) AS BIGINT) AS skipped_ppm
          FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
    ),
}
