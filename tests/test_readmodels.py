from decimal import Decimal

from pyspark.sql import functions as F

from fairline.plans import catalog_stored
from fairline.plans.readmodels import market_margin, quote_history


def margins(spark, prices):
    rows = [(event, side, Decimal(p)) for event, sides in prices.items() for side, p in zip(("home", "draw", "away"), sides)]
    best = spark.createDataFrame(rows, "event string, side string, best_odds decimal(18,8)")
    return {r["event"]: (r["implied_ppm"], r["is_arbitrage"]) for r in market_margin(best, ["event"], "side", ["home", "draw", "away"]).collect()}


def test_arbitrage_is_exact(spark):
    got = margins(
        spark,
        {
            "even": ("3", "3", "3"), "just": ("3", "3", "3.00000001"), "over": ("2.9", "3", "3"), "thirds": ("2", "3", "6"),
            "two sides": ("1.5", "9"), "large": ("20000", "1.00004", "90000"), "big edge": ("20000", "1.5", "90000"),
        },
    )
    assert got["even"] == (1_000_000, False) and got["thirds"] == (1_000_000, False)
    assert got["just"][1] and not got["over"][1] and got["over"][0] > 1_000_000
    assert "two sides" not in got and not got["large"][1] and got["big edge"][1]


def test_history_lists_and_reads_only_the_days_it_is_bounded_by(spark):
    folder = "/root/testdata/sf0.001"
    store = catalog_stored.stored_quotes(spark, folder)
    parts = spark.read.parquet(f"{folder}/part.parquet")
    selections = parts.selectExpr("cast(p_partkey as string) id", "'m' market_id", "'x' selection_type", "cast(null as string) participant_id")
    markets = spark.createDataFrame([("m", "e", "total", "full_time", None)], "id string, event_id string, market_type string, period string, line decimal(18,8)")
    bound = lambda text: F.lit(text).cast("timestamp")
    rows = quote_history(store.read("odds_quotes"), selections, markets, start=bound("1995-01-01"), end=bound("1995-03-31"))
    every = store.read("odds_quotes")
    assert rows.count() == every.where("coalesce(source_updated_at, observed_at) between '1995-01-01' and '1995-03-30'").count() > 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    days = {r["day"] for r in rows.join(every.select("id", "day"), "id").select("day").distinct().collect()}
    assert {d.isoformat() for d in days} == {"1995-01-01", "1995-02-01", "1995-03-01"}
