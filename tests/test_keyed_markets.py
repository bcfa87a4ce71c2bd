"""The keyed feed's markets: grouped inside their payload, shuffled once, to their definitions."""

import json
import re

from fairline.plans import views
from fairline.sources import keyed_feed


def _payloads(spark):
    def quote(market, outcome, own=None, **more):
        return {"bookmaker": "keyed", "marketId": market, "outcomeId": outcome, "bookmakerMarketId": own, "price": "2.5", "active": True, "marketActive": True, **more}

    odds = {
        "a": quote(7, 1), "b": quote(5, 1, "x"), "c": quote(7, 2), "d": quote(5, 2), "e": quote(5, 3, "x", marketActive=False), "f": quote(None, 1), "g": quote(7, 3, " "),
    }
    documents = [
        {"fixtureId": f"f{i}", "status": {"live": False, "statusId": 0}, "bookmakers": {"keyed": {"bookmaker": "keyed", "suspended": False}}, "odds": {"keyed": held}}
        for i, held in enumerate([odds, odds, {}])
    ]
    definitions = [{"marketId": 7, "marketName": "seven", "outcomes": [{"outcomeId": 2, "outcomeName": "two"}]}]
    rows = spark.createDataFrame([(json.dumps(d),) for d in documents], "payload string")
    return rows, spark.createDataFrame([(json.dumps(definitions),)], "payload string")


def test_quotes_of_a_market_come_together_in_order(spark):
    rows = keyed_feed.markets(*_payloads(spark), "keyed").collect()
    got = sorted((r.event_source_id, r.source_id, r.name, r.status, r.position, [(s.source_id, s.label) for s in r.selections], r.metadata["skipped_quotes"]) for r in rows)
    assert got == sorted(
        row for f in ("f0", "f1") for row in (
            (f, "7", "seven", "open", 0, [("a", "1"), ("c", "two"), ("g", "3")], "1"),
            (f, "5", None, "open", 3, [("d", "2")], "1"),
            (f, "x", None, "suspended", 1, [("b", "1"), ("e", "3")], "1"),
        )
    )


def test_markets_are_shuffled_to_their_definitions_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keyed_feed.markets(*_payloads(spark), "keyed")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The definitions into one row each, and the markets; before, also the quotes into markets.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_a_scan_with_splits_for_all_cores_is_not_dealt_out(spark, tmp_path):
    spark.range(2000).repartition(40).write.parquet(f"{tmp_path}/many.parquet")
    spark.range(2000).coalesce(1).write.parquet(f"{tmp_path}/one.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        many = views.spread(views.table(spark, str(tmp_path), "many"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    one = views.spread(views.table(spark, str(tmp_path), "one"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in many and "Exchange" in one
