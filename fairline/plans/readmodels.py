"""Read models over the quote history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.operators import structural

PPM = 1_000_000


def quote_history(
    quotes: DataFrame,
    selections: DataFrame,
    markets: DataFrame,
    event_id: str | None = None,
    market_id: str | None = None,
    selection_id: str | None = None,
    bookmaker_id: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Stored quotes with their market and selection, bounded by any of the arguments.

    A quote's time is its source's or else when it was seen, which is also what its ``day`` directory says: a time bound bounds
    the directories, so only those are read.
    """
    rows = quotes
    time = F.coalesce("source_updated_at", "observed_at")
    if start is not None:
        rows = rows.filter(time >= start)
    if end is not None:
        rows = rows.filter(time < end)
    if "day" in quotes.columns:
        if start is not None:
            rows = rows.filter(F.col("day") >= F.to_date(start))
        if end is not None:
            rows = rows.filter(F.col("day") <= F.to_date(end))
        rows = rows.drop("day")
    if bookmaker_id is not None:
        rows = rows.filter(F.col("bookmaker_id") == bookmaker_id)
    if selection_id is not None:
        rows = rows.filter(F.col("selection_id") == selection_id)
    sides = selections.select(F.col("id").alias("selection_id"), "market_id", "selection_type", "participant_id")
    parents = markets.select(F.col("id").alias("market_id"), "event_id", "market_type", "period", "line")
    if market_id is not None:
        sides = sides.filter(F.col("market_id") == market_id)
    if event_id is not None:
        parents = parents.filter(F.col("event_id") == event_id)
    return rows.join(sides, "selection_id").join(parents, "market_id")


def best_prices(latest: DataFrame, event: list[str], outcome: str) -> DataFrame:
    """Best available price, its book (smallest code on ties), price spread and book count."""
    best = F.min(F.struct((-F.col("decimal_odds")).alias("cost"), "bookmaker"))
    return (
        latest.filter("is_available AND decimal_odds IS NOT NULL")
        .groupBy(*event, outcome)
        .agg(
            F.max("decimal_odds").alias("best_odds"),
            best.alias("__best"),
            (F.max("decimal_odds") - F.min("decimal_odds")).cast("decimal(18,8)").alias("price_spread"),
            F.count("*").alias("n_books"),
        )
        .withColumn("best_book", F.col("__best.bookmaker"))
        .drop("__best")
    )


def structural_prices(quotes: DataFrame, selections: DataFrame, markets: DataFrame, event_participants: DataFrame, order: list[str]) -> DataFrame:
    """Best latest price of every structurally complete outcome over all books, by market and selection key with the line.

    Outcomes are compared by what they mean, whatever ids they have: books that share ids and books that have their own give the
    same rows. What is incomplete (no known market type, a total without a line, a side without a participant) takes no part.
    """
    kinds = structural.complete_markets(markets)
    listed = selections.select(F.col("id").alias("selection_id"), "market_id", "selection_type", "participant_id", "line")
    named = [F.col(c).alias(f"key_{c}") for c in structural.MARKET_KEY]
    sides = listed.join(kinds.select(F.col("id").alias("market_id"), "event_id", F.col("line").alias("market_line"), *named), "market_id")
    # The market's key goes along with its sides, so markets are met once.
    sides = structural.complete_selections(sides, event_participants).select(
        "selection_id", *[F.col(f"key_{c}").alias(c) for c in structural.MARKET_KEY], "selection_type", "participant_id", "effective_line"
    )
    latest = quotes.groupBy("bookmaker_id", "selection_id").agg(F.max_by(F.struct("decimal_odds", "is_available"), F.struct(*order)).alias("q"))
    keyed = latest.select("selection_id", F.col("bookmaker_id").alias("bookmaker"), "q.*").join(sides, "selection_id")
    # Of one book's own outcomes with one meaning the best counts, so a book is counted once.
    outcome = [*structural.MARKET_KEY, "selection_type", "participant_id", "effective_line"]
    once = keyed.groupBy(*outcome, "bookmaker").agg(F.max(F.when(F.col("is_available"), F.col("decimal_odds"))).alias("decimal_odds")).withColumn("is_available", F.lit(True))
    return best_prices(once, outcome[:-1], outcome[-1])


def market_margin(best: DataFrame, event: list[str], outcome: str, wanted: list[str]) -> DataFrame:
    """Sum of implied probabilities over markets that have a best price for each of the ``wanted`` two or three outcomes.

    ``is_arbitrage`` is exact: the sum of 1 / odds is under one if, in units of 1e-8, the products of all but one price sum up
    to less than the product of all; prices from 10,000 on are compared by quotients of 18 decimals, rounded up.
    ``implied_ppm`` is the sum in parts per million, rounded down from 18 decimals.
    """
    names = [f"o{i}" for i in range(len(wanted))]
    units = (F.col("best_odds").cast("decimal(28,8)") * 100_000_000).cast("decimal(36,0)")
    sides = best.groupBy(*event).agg(*[F.max(F.when(F.col(outcome) == w, units)).alias(n) for n, w in zip(names, wanted, strict=True)])
    for n in names:
        sides = sides.filter(F.col(n).isNotNull())
    quotients = [F.expr(f"100000000000000000000000000BD div {n}") for n in names]
    total = sum(quotients[1:], quotients[0])
    small = F.greatest(*names) < 1_000_000_000_000

    def product(of: list[str]) -> Column:
        out = F.expr(f"try_cast({of[0]} AS DECIMAL(12,0))")
        for n in of[1:]:
            out = out * F.expr(f"try_cast({n} AS DECIMAL(12,0))")
        return out

    parts = [product([m for m in names if m != n]) for n in names]
    exact = sum(parts[1:], parts[0]) * F.lit(100_000_000).cast("decimal(9,0)") < product(names)
    ppm = F.floor((total + len(wanted) - 1) / F.lit(10**12).cast("decimal(13,0)")).cast("bigint")
    return sides.select(
        *event, ppm.alias("implied_ppm"), (ppm - PPM).alias("margin_ppm"),
        F.when(small, exact).otherwise(total + len(wanted) < 10**18).alias("is_arbitrage"),
    )


def price_ranges(quotes: DataFrame, series: list[str], order: list[Column]) -> DataFrame:
    """Open, high, low, close and count per series, in one aggregation."""
    rank = F.struct(*order)
    return (
        quotes.filter("decimal_odds IS NOT NULL")
        .groupBy(*series)
        .agg(
            F.min_by("decimal_odds", rank).alias("open_odds"),
            F.max("decimal_odds").alias("high_odds"),
            F.min("decimal_odds").alias("low_odds"),
            F.max_by("decimal_odds", rank).alias("close_odds"),
            F.count("*").alias("n_quotes"),
        )
    )


def freshness(quotes: DataFrame, book: str, time: str, now: Column) -> DataFrame:
    """Age of the last quote, unavailable and total counts per book."""
    return quotes.groupBy(book).agg(
        F.max(time).alias("last_seen"),
        (F.unix_seconds(now) - F.unix_seconds(F.max(time).cast("timestamp"))).alias("age_seconds"),
        F.count("*").alias("n_quotes"),
        F.count_if(~F.col("is_available")).alias("n_unavailable"),
        F.floor(F.count_if(~F.col("is_available")) * PPM / F.count("*")).alias("unavailable_ppm"),
    )


def skipped_share(runs: DataFrame) -> DataFrame:
    """Per book over its finished runs: records received, records skipped, and their share in parts per million."""
    done = runs.filter("status <> 'running'").groupBy("bookmaker_id").agg(
        F.count("*").alias("n_runs"), F.sum("received_count").alias("received_count"), F.sum("rejected_count").alias("skipped_count")
    )
    return done.withColumn("skipped_ppm", F.expr(f"skipped_count * {PPM} div nullif(received_count, 0)"))


def alerts(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule_id, kind, threshold) met by changes (kind, subject, at, amount).

    Rules join on their kind and never multiply the changes of another kind. A rule table is
    hand-written, so its size statistics make this a broadcast join without a hint.
    """
    return changes.join(rules, "kind").filter(F.col("amount") >= F.col("threshold")).select(
        "rule_id", "kind", "subject", "at", "amount"
    )


def review_queue(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Open decisions with their ranked candidates."""
    listed = candidates.groupBy("decision_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "candidate_id", "score"))).alias("candidates")
    )
    # At most five candidates are ever stored per decision.
    return decisions.filter(F.col("state").isin("ambiguous", "unresolved")).join(
        listed, decisions["id"] == listed["decision_id"], "left"
    ).drop("decision_id")
