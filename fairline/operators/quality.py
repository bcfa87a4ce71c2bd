"""Row checks, feed contract report and operational summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.text import strip


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking any rule, with the broken rules' names. A rule is true where it is broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: rows checked and rows breaking it, counted in one pass."""
    counts = df.agg(
        F.count("*").alias("checked"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()],
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])
    return counts.select("checked", F.explode(pairs).alias("r")).select("r.rule", "checked", "r.broken")


def bad_id(col: Column) -> Column:
    return col.isNull() | (col == "") | (strip(col) != col)


def bad_price(odds: Column, available: Column) -> Column:
    return (available & (odds.isNull() | (odds <= 1))) | (~available & odds.isNotNull())


def event_rules() -> dict[str, Column]:
    """Contract of source events; embedded records repeat the ids that refer to them."""
    person = lambda p: bad_id(p["source_id"])
    clash = lambda p: F.coalesce(p["participant"]["source_id"] != p["source_id"], F.lit(False))
    return {
        "event_id": bad_id(F.col("source_id")),
        "sport_id": bad_id(F.col("sport_source_id")),
        "start_time": F.col("start_time").isNull(),
        "participant_id": F.exists("participants", person),
        "participant_reference": F.exists("participants", clash),
        "competition_reference": F.col("competition.source_id") != F.col("competition_source_id"),
        "competition_sport": F.col("competition.sport_source_id") != F.col("sport_source_id"),
    }


def market_rules() -> dict[str, Column]:
    return {
        "market_id": bad_id(F.col("source_id")),
        "event_id": bad_id(F.col("event_source_id")),
        "selection_id": F.exists("selections", lambda s: s["source_id"].isNotNull() & bad_id(s["source_id"])),
        "price": F.exists("selections", lambda s: bad_price(s["price"]["decimal_odds"], s["price"]["is_available"])),
    }


def resolution_metrics(decisions: DataFrame) -> DataFrame:
    """Decision counts by entity type and rule version, one column per state."""
    states = ["matched", "created", "ambiguous", "unresolved", "rejected"]
    return decisions.groupBy("entity_type", "rule_version").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in states]
    )


def operation_metrics(metrics: DataFrame) -> DataFrame:
    """Attempts, latency, waits, retries and errors by book and operation."""
    return metrics.groupBy("bookmaker", "operation").agg(
        F.count("*").alias("n_operations"),
        F.sum("attempts").alias("attempts"),
        F.sum(F.col("attempts") - 1).alias("retries"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum("rate_limit_wait_ms").alias("rate_limit_wait_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.percentile_approx("latency_ms", 0.95, 10000).alias("p95_latency_ms"),
    )


def run_counters(events: Column, skipped: Column, markets: Column, selections: Column, appended: Column) -> Column:
    """received / accepted / rejected and the run's status."""
    return F.struct(
        (events + skipped + markets + selections).alias("received_count"),
        appended.alias("accepted_count"),
        skipped.alias("rejected_count"),
        F.when(skipped > 0, "partial").otherwise("succeeded").alias("status"),
    )
