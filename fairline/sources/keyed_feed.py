"""Feed with objects keyed by book and odds id, and a separate market-definition dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.scalars import (
    PRICE,
    aware_timestamp,
    epoch_millis,
    epoch_seconds,
    lenient_decimal,
    lenient_integer,
)
from fairline.functions.text import alphanumeric_token, blank_to_null
from fairline.sources.payloads import lookup, once, parsed_list, parsed_object, payload_file, required, text_map

# The provider name this layout carries in its metadata.
PROVIDER = "oddspapi"

_META = (
    "STRUCT<bookmaker:STRING,bookmakerFixtureId:STRING,hasOdds:BOOLEAN,staleOdds:BOOLEAN,suspended:BOOLEAN,"
    "participantsRotated:BOOLEAN,updatedAt:STRING>"
)
_FIXTURE = (
    "fixtureId:STRING,status:STRUCT<live:BOOLEAN,statusId:STRING,statusName:STRING>,"
    "sport:STRUCT<sportId:STRING,sportName:STRING>,"
    "tournament:STRUCT<tournamentId:STRING,tournamentName:STRING,categoryName:STRING>,"
    "season:STRUCT<seasonName:STRING>,startTime:STRING,"
    "participants:STRUCT<participant1Id:STRING,participant1Name:STRING,participant2Id:STRING,participant2Name:STRING>,"
    f"bookmakers:MAP<STRING,{_META}>"
)
_QUOTE = (
    "STRUCT<bookmaker:STRING,outcomeId:STRING,price:STRING,active:BOOLEAN,marketActive:BOOLEAN,marketId:STRING,"
    "bookmakerMarketId:STRING,bookmakerOutcomeId:STRING,bookmakerChangedAt:STRING,changedAt:STRING>"
)
_DEFINITION = (
    "marketId:STRING,playerProp:BOOLEAN,handicap:STRING,period:STRING,marketType:STRING,marketName:STRING,"
    "outcomes:ARRAY<STRUCT<outcomeId:STRING,outcomeName:STRING>>"
)

# Outcome labels of the three-way market.
_OUTCOME_TYPES = {"1": "home", "x": "draw", "2": "away"}


def numeric_id(value: str, field: str) -> int:
    """A feed request's id: a non-negative integer."""
    if not value.strip().isdigit():
        raise ValueError(f"{field} must be a non-negative numeric id")
    return int(value)


def coverage(payloads: DataFrame, slug: str) -> DataFrame:
    rows = parsed_list(payloads, "slug:STRING,active:BOOLEAN", "bookmakers")
    listed = (blank_to_null(F.col("item.slug")) == slug) & F.col("item.active")
    return rows.agg(F.coalesce(F.bool_or(F.coalesce(listed, F.lit(False))), F.lit(False)).alias("healthy"))


def sports(payloads: DataFrame) -> DataFrame:
    rows = parsed_list(payloads, "sportId:STRING,slug:STRING,sportName:STRING", "sports")
    return rows.select(
        lenient_integer(F.col("item.sportId")).cast("string").alias("source_id"),
        blank_to_null(F.col("item.sportName")).alias("name"),
        F.lit(None).cast("string").alias("code"),
        text_map(provider=F.lit(PROVIDER), provider_slug=blank_to_null(F.col("item.slug"))).alias("metadata"),
    ).filter("source_id IS NOT NULL AND name IS NOT NULL")


def _is_pregame(fixture: Column) -> Column:
    started = lenient_integer(fixture["status"]["statusId"])
    return F.coalesce((started == 0) & ~fixture["status"]["live"], F.lit(False))


def _book_meta(fixture: Column, slug: str) -> Column:
    """The book's own entry, if it names itself consistently."""
    meta = F.try_element_at(fixture["bookmakers"], F.lit(slug))
    return F.when(blank_to_null(meta["bookmaker"]) == slug, meta)


def _participant_id(fixture: Column, position: int) -> Column:
    return lenient_integer(fixture["participants"][f"participant{position}Id"]).cast("string")


def events(
    payloads: DataFrame, slug: str, since: Column | None = None, sport_source_id: str | None = None
) -> DataFrame:
    """SourceEvent rows: pregame fixtures of the book with two identified participants."""
    rows = parsed_list(payloads, _FIXTURE, "fixtures").withColumn("payload_file", payload_file(payloads)).withColumn("meta", once(_book_meta(F.col("item"), slug)))
    f = F.col("item")

    def person(position: int) -> Column:
        identity = _participant_id(f, position)
        name = blank_to_null(f["participants"][f"participant{position}Name"])
        return F.struct(
            identity.alias("source_id"),
            F.lit(None).cast("string").alias("role"),
            F.lit(position).alias("position"),
            F.when(
                name.isNotNull(),
                F.struct(
                    identity.alias("source_id"), name.alias("name"), F.lit(None).cast("string").alias("participant_type")
                ),
            ).alias("participant"),
        )

    out = (
        rows.filter(_is_pregame(f) & F.col("meta").isNotNull())
        .withColumn("source_id", blank_to_null(f["fixtureId"]))
        .withColumn("start_time", epoch_seconds(lenient_integer(f["startTime"])))
        .withColumn("sport_source_id", lenient_integer(f["sport"]["sportId"]).cast("string"))
        .withColumn("competition_source_id", lenient_integer(f["tournament"]["tournamentId"]).cast("string"))
        .withColumn("tournament_name", blank_to_null(f["tournament"]["tournamentName"]))
        .withColumn("participants", once(F.filter(F.array(person(1), person(2)), lambda p: p["source_id"].isNotNull())))
        .filter(
            "source_id IS NOT NULL AND start_time IS NOT NULL AND sport_source_id IS NOT NULL "
            "AND competition_source_id IS NOT NULL AND tournament_name IS NOT NULL AND size(participants) = 2"
        )
    )
    if since is not None:
        out = out.filter(F.col("start_time") >= since)
    if sport_source_id is not None:
        out = out.filter(F.col("sport_source_id") == sport_source_id)
    names = F.filter(F.transform("participants", lambda p: p["participant"]["name"]), lambda n: n.isNotNull())
    return out.select(
        "source_id",
        "sport_source_id",
        "competition_source_id",
        F.struct(
            F.col("competition_source_id").alias("source_id"), "sport_source_id", F.col("tournament_name").alias("name"),
            F.lit(None).cast("string").alias("country_code"), blank_to_null(f["season"]["seasonName"]).alias("season"),
        ).alias("competition"),
        F.when(F.size(names) == 2, F.array_join(names, " - ")).alias("name"),
        "participants",
        "start_time",
        F.lit("scheduled").alias("status"),
        F.lit(False).alias("is_live"),
        aware_timestamp(blank_to_null(F.col("meta.updatedAt"))).alias("source_updated_at"),
        text_map(
            provider=F.lit(PROVIDER), bookmaker=F.lit(slug),
            bookmaker_fixture_id=blank_to_null(F.col("meta.bookmakerFixtureId")),
            participants_rotated=F.col("meta.participantsRotated"),
        ).alias("metadata"),
        "payload_file",
        "position",
    )


def definitions(payloads: DataFrame) -> DataFrame:
    """Market-definition dimension: the last definition of an id wins."""
    rows = parsed_list(payloads, _DEFINITION, "markets").withColumn("market_id", lenient_integer(F.col("item.marketId")))
    names = F.filter(
        F.transform(
            "item.outcomes",
            lambda o: F.struct(
                lenient_integer(o["outcomeId"]).alias("outcome_id"), blank_to_null(o["outcomeName"]).alias("name")
            ),
        ),
        lambda o: o["outcome_id"].isNotNull() & o["name"].isNotNull(),
    )
    described = F.struct(
        F.lit(True).alias("known"),
        blank_to_null(F.col("item.marketName")).alias("name"),
        alphanumeric_token(F.col("item.marketType")).alias("type_token"),
        alphanumeric_token(F.col("item.period")).alias("period_token"),
        F.col("item.playerProp").alias("player_prop"),
        lenient_decimal(F.col("item.handicap")).alias("handicap"),
        names.alias("outcome_names"),
    )
    return (
        rows.filter("market_id IS NOT NULL")
        .groupBy("market_id")
        .agg(F.max_by(described, F.col("position")).alias("definition"))
    )


def is_three_way(definition: Column, rotated: Column) -> Column:
    """Full-time three-way market whose sides are certain: an unknown rotation blocks it."""
    handicap = definition["handicap"]
    return F.coalesce(
        (definition["type_token"] == "1x2")
        & (definition["period_token"] == "fulltime")
        & ~F.coalesce(definition["player_prop"], F.lit(False))
        & (handicap.isNull() | (handicap == 0))
        & ~rotated,
        F.lit(False),
    )


def odds_problem(payloads: DataFrame, slug: str) -> Column:
    """Why a fixture's odds would fail a batch, for ``sound_and_rejected``; null for a sound payload.

    Besides the root these are an id that isn't the fixture's asked for, and, where the book lists the fixture before its start, a
    missing suspended flag or missing odds.
    """
    root = F.from_json("payload", f"STRUCT<{_FIXTURE},odds:MAP<STRING,MAP<STRING,{_QUOTE}>>>")
    asked = F.col("event_source_id") if "event_source_id" in payloads.columns else F.lit(None).cast("string")

    def judged(r: Column) -> Column:
        fixture, meta = blank_to_null(r["fixtureId"]), _book_meta(r, slug)
        listed = _is_pregame(r) & meta.isNotNull()
        return (
            F.when(F.coalesce(fixture != asked, F.lit(False)), "fixture odds changed fixtureId")
            .when(listed & meta["suspended"].isNull(), "book suspended flag is missing or has the wrong type")
            .when(listed & r["odds"].isNull(), "odds is missing or has the wrong type")
        )

    no_object = F.col("payload").isNull() | ~F.col("payload").rlike(r"\A\s*\{")
    return F.when(no_object, F.lit("the root is no object")).otherwise(F.get(F.transform(F.array(root), judged), F.lit(0)))


def _fixtures(payloads: DataFrame, slug: str) -> DataFrame:
    """One row per pregame fixture of the book with its facts, the usable quotes ``kept`` and the skipped count."""
    numbered = payloads.withColumn("payload_id", F.monotonically_increasing_id()).withColumn("payload_file", payload_file(payloads))
    rows = parsed_object(numbered, f"{_FIXTURE},odds:MAP<STRING,MAP<STRING,{_QUOTE}>>", "fixture odds")
    fixture = blank_to_null(F.col("root.fixtureId"))
    if "event_source_id" in payloads.columns:
        changed = fixture.isNotNull() & (fixture != F.col("event_source_id"))
        event_id = F.when(changed, F.raise_error(F.lit("fixture odds changed fixtureId"))).otherwise(F.col("event_source_id"))
    else:
        event_id = fixture
    fixtures = (
        rows.withColumn("event_source_id", event_id)
        .withColumn("meta", once(_book_meta(F.col("root"), slug)))
        .filter(_is_pregame(F.col("root")) & F.col("meta").isNotNull())
        .withColumn("suspended", required(F.col("meta.suspended"), "book suspended flag"))
        .withColumn("book_odds", once(F.try_element_at(required(F.col("root.odds"), "odds"), F.lit(slug))))
        .filter("book_odds IS NOT NULL")
    )

    def usable(entry: Column) -> Column:
        quote = entry["value"]
        return F.coalesce(
            (blank_to_null(quote["bookmaker"]) == slug)
            & lenient_integer(quote["marketId"]).isNotNull()
            & lenient_integer(quote["outcomeId"]).isNotNull(),
            F.lit(False),
        )

    kept = fixtures.withColumn("kept", once(F.filter(F.map_entries("book_odds"), usable))).withColumn(
        "skipped", F.size("book_odds") - F.size("kept")
    )
    root = F.col("root")
    return kept.select(
        "payload_id",
        "payload_file",
        "event_source_id",
        "meta",
        "suspended",
        "skipped",
        _participant_id(root, 1).alias("home_id"),
        _participant_id(root, 2).alias("away_id"),
        "kept",
    )


def _source_market_id(quote: Column) -> Column:
    return F.coalesce(blank_to_null(quote["bookmakerMarketId"]), lenient_integer(quote["marketId"]).cast("string"))


def quotes(payloads: DataFrame, slug: str) -> DataFrame:
    """One row per usable quote of the book, with its fixture's facts and the skipped count."""
    facts = ["payload_id", "payload_file", "event_source_id", "meta", "suspended", "skipped", "home_id", "away_id"]
    return _fixtures(payloads, slug).select(*facts, F.posexplode("kept").alias("position", "entry")).select(
        *facts, "position",
        lenient_integer(F.col("entry.value.marketId")).alias("market_id"),
        _source_market_id(F.col("entry.value")).alias("source_market_id"),
        F.col("entry.key").alias("odds_id"),
        F.col("entry.value").alias("quote"),
    )


def _by_market(kept: Column) -> Column:
    """A fixture's quotes cut into its markets: they are sorted by market, then position, and cut where the market changes."""
    listed = F.transform(
        kept,
        lambda e, i: F.struct(
            lenient_integer(e["value"]["marketId"]).alias("market_id"), _source_market_id(e["value"]).alias("source_market_id"),
            i.alias("position"), e["key"].alias("odds_id"), e["value"].alias("quote"),
        ),
    )

    def cut(entries: Column) -> Column:
        def begins(i: Column) -> Column:
            own, last = F.get(entries, i), F.get(entries, i - 1)
            return (i == 0) | (own["market_id"] != last["market_id"]) | (own["source_market_id"] != last["source_market_id"])

        places = F.sequence(F.lit(0), F.size(entries) - 1)
        starts = F.when(F.size(entries) > 0, F.filter(places, begins)).otherwise(F.array().cast("array<int>"))

        def markets(first: Column) -> Column:
            return F.transform(first, lambda at, k: F.slice(entries, at + 1, F.coalesce(F.get(first, k + 1), F.size(entries)) - at))

        # Lambda variables hold a value that several places need.
        return F.get(F.transform(F.array(starts), markets), F.lit(0))

    return F.get(F.transform(F.array(F.array_sort(listed)), cut), F.lit(0))


def markets(odds_payloads: DataFrame, definition_payloads: DataFrame, slug: str) -> DataFrame:
    """SourceMarket rows: quotes grouped by market, joined to the definitions; stale feeds overlaid.

    A market is in one payload, so its quotes are brought together inside the payload's row, and what meets the definitions holds
    only what the result needs.
    """
    facts = ["payload_file", "event_source_id", "skipped", "home_id", "away_id"]
    grouped = (
        _fixtures(odds_payloads, slug)
        .select(*facts, "meta", "suspended", F.explode(once(_by_market(F.col("kept")))).alias("quotes"))
        .withColumn(
            "closed",
            once(F.col("suspended") | F.exists("quotes", lambda q: F.coalesce(~q["quote"]["marketActive"], F.lit(False)))),
        )
        .withColumn("stale", F.coalesce(F.col("meta.staleOdds"), F.lit(False)))
    )

    def offer(entry: Column) -> Column:
        quote = entry["quote"]
        price = lenient_decimal(quote["price"])
        available = (
            ~F.col("closed") & ~F.col("stale") & F.coalesce(quote["active"], F.lit(False)) & F.coalesce(price > 1, F.lit(False))
        )
        return F.struct(
            F.coalesce(blank_to_null(quote["bookmakerOutcomeId"]), entry["odds_id"]).alias("source_id"),
            lenient_integer(quote["outcomeId"]).alias("outcome"),
            F.struct(
                F.when(available, price).alias("decimal_odds"),
                available.alias("is_available"),
                F.coalesce(
                    epoch_millis(lenient_integer(quote["bookmakerChangedAt"])), epoch_millis(lenient_integer(quote["changedAt"]))
                ).alias("source_updated_at"),
            ).alias("price"),
        )

    first = F.get("quotes", F.lit(0))
    offered = grouped.select(
        *facts,
        first["market_id"].alias("market_id"), first["source_market_id"].alias("source_market_id"), first["position"].alias("position"),
        F.col("meta.participantsRotated").alias("rotated"), F.col("meta.bookmakerFixtureId").alias("book_fixture"), "closed", "stale",
        once(F.transform("quotes", offer)).alias("offers"),
    )
    joined = offered.join(definitions(definition_payloads), "market_id", "left").withColumn(
        "three_way", is_three_way(F.col("definition"), F.col("rotated"))
    )

    def selection(one: Column) -> Column:
        outcome = one["outcome"]
        named = F.filter(F.col("definition.outcome_names"), lambda o: o["outcome_id"] == outcome)
        label = F.coalesce(F.try_element_at(named, F.lit(-1))["name"], outcome.cast("string"))
        kind = F.when(F.col("three_way"), lookup(_OUTCOME_TYPES, F.lower(F.trim(label))))
        return F.struct(
            one["source_id"].alias("source_id"),
            label.alias("label"),
            kind.alias("selection_type"),
            F.when(kind == "home", F.col("home_id")).when(kind == "away", F.col("away_id")).alias("participant_source_id"),
            F.lit(None).cast(PRICE).alias("line"),
            one["price"].alias("price"),
        )

    built = joined.withColumn("selections", once(F.transform("offers", selection)))
    return built.select(
        F.col("source_market_id").alias("source_id"),
        "event_source_id",
        F.col("definition.name").alias("name"),
        F.when(F.col("three_way"), "moneyline").alias("market_type"),
        F.when(F.col("three_way"), "full_time").alias("period"),
        F.lit(None).cast("string").alias("scope"),
        F.lit(None).cast(PRICE).alias("line"),
        F.when(F.col("closed"), "suspended").otherwise("open").alias("status"),
        "selections",
        F.array_max(F.transform("selections", lambda s: s["price"]["source_updated_at"])).alias("source_updated_at"),
        text_map(
            provider=F.lit(PROVIDER), bookmaker=F.lit(slug), provider_market_id=F.col("market_id"),
            bookmaker_market_id=F.when(F.col("source_market_id") != F.col("market_id").cast("string"), F.col("source_market_id")),
            bookmaker_fixture_id=blank_to_null(F.col("book_fixture")),
            skipped_quotes=F.col("skipped"),
            stale_odds=F.when(F.col("stale"), F.lit("true")),
        ).alias("metadata"),
        "payload_file",
        "position",
    )
