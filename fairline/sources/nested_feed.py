"""Feed with nested arrays: books, sports, schedules and markets of many books in one payload."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.scalars import PRICE, aware_timestamp, lenient_boolean, lenient_decimal
from fairline.functions.text import blank_to_null, id_suffix, numeric_id_suffix, provider_token
from fairline.sources.payloads import lookup, once, parsed_object, payload_file, required, text_map

_NAMED = "STRUCT<id:STRING,name:STRING>"
_EVENT = (
    "id:STRING,start_time:STRING,scheduled:STRING,status:STRING,name:STRING,"
    "competitors:ARRAY<STRUCT<id:STRING,name:STRING,qualifier:STRING>>,"
    f"sport_event_context:STRUCT<sport:{_NAMED},competition:{_NAMED}>,"
    f"sport:{_NAMED},competition:{_NAMED},tournament:{_NAMED}"
)
_SCHEDULES = f"ARRAY<STRUCT<sport_event:STRUCT<{_EVENT}>,{_EVENT}>>"
_OUTCOME = (
    "STRUCT<id:STRING,external_outcome_id:STRING,type:STRING,player_name:STRING,odds_decimal:STRING,"
    "handicap:STRING,spread:STRING,total:STRING,removed:STRING>"
)
_BOOK = (
    "STRUCT<id:STRING,name:STRING,external_market_id:STRING,external_sport_event_id:STRING,removed:STRING,"
    f"outcomes:ARRAY<{_OUTCOME}>>"
)

# Provider status words and the shared status each stands for.
_STATUS = {
    "not_started": "scheduled", "scheduled": "scheduled",
    "live": "live", "1st_half": "live", "2nd_half": "live", "halftime": "live", "overtime": "live",
    "awaiting_penalties": "live", "penalties": "live", "in_progress": "live",
    "ended": "finished", "closed": "finished", "finished": "finished",
    "cancelled": "cancelled", "canceled": "cancelled",
    "postponed": "postponed", "delayed": "postponed",
    "suspended": "suspended", "interrupted": "suspended",
}

# Provider market names and ids with a certain meaning, as (type, period).
_NAME_MEANING = {
    "1x2": ("moneyline", "full_time"),
    "2way": ("moneyline", "full_time"),
    "3way": ("moneyline", "full_time"),
    "total": ("total", "full_time"),
    "spread": ("spread", "full_time"),
    "1x2_half_time": ("moneyline", "first_half"),
}
_ID_MEANING = {"1": ("moneyline", "full_time"), "18": ("total", "full_time"), "60": ("moneyline", "first_half")}

# Documented market ids whose meaning is outside the supported registry.
_UNSUPPORTED_IDS = [
    "11", "14", "19", "20", "23", "26", "47", "64", "66", "68", "69", "70", "74", "83", "94", "219", "220", "223",
    "225", "227", "228", "231", "232", "234", "235", "236", "251", "256", "260", "261", "274", "275", "276", "293",
    "294", "302", "303", "304", "1123", "1124", "6022", "6023", "6024", "6025", "6026", "6027", "6028", "6029", "6030",
    "6031", "6032", "8010", "8011",
]

# Selection types each market type allows.
_ALLOWED = {"moneyline": ["home", "away", "draw"], "total": ["over", "under"], "spread": ["home", "away"]}


@dataclass(frozen=True)
class Book:
    """The book wanted from the payloads: matched by numeric id suffix or by name."""

    id: str
    name: str
    # Fixed value: the provider name this layout carries in its metadata.
    provider: str = "sportradar"

    def matches(self, book: Column) -> Column:
        wanted = self.id.rsplit(":", 1)[-1]
        by_id = F.coalesce(id_suffix(blank_to_null(book["id"])) == wanted, F.lit(False))
        by_name = F.coalesce(F.lower(blank_to_null(book["name"])) == self.name.lower(), F.lit(False))
        return by_id | by_name


def coverage(payloads: DataFrame, book: Book) -> DataFrame:
    """One row: does any payload list the wanted book."""
    rows = parsed_object(payloads, f"books:ARRAY<{_NAMED}>", "books")
    found = F.exists(required(F.col("root.books"), "books"), lambda b: book.matches(b))
    return rows.agg(F.coalesce(F.bool_or(found), F.lit(False)).alias("healthy"))


def sports(payloads: DataFrame, book: Book) -> DataFrame:
    rows = parsed_object(payloads, "sports:ARRAY<STRUCT<id:STRING,name:STRING,type:STRING>>", "sports")
    items = rows.select(F.posexplode(required(F.col("root.sports"), "sports")).alias("position", "s"))
    return (
        items.select(
            blank_to_null(F.col("s.id")).alias("source_id"),
            blank_to_null(F.col("s.name")).alias("name"),
            F.lit(None).cast("string").alias("code"),
            text_map(
                provider=F.lit(book.provider), book=F.lit(book.name), provider_type=blank_to_null(F.col("s.type"))
            ).alias("metadata"),
        )
        .filter("source_id IS NOT NULL AND name IS NOT NULL")
    )


def _names(entry: Column) -> Column:
    return F.struct(blank_to_null(entry["id"]).alias("id"), blank_to_null(entry["name"]).alias("name"))


def events(
    payloads: DataFrame,
    book: Book,
    since: Column | None = None,
    sport_source_id: str | None = None,
    competition_source_id: str | None = None,
) -> DataFrame:
    """SourceEvent rows. The two ids are the feed request's own and fill gaps in the payload."""
    rows = parsed_object(
        payloads, f"generated_at:STRING,schedules:{_SCHEDULES},sport_events:{_SCHEDULES}", "event schedules"
    )
    listed = required(F.coalesce("root.schedules", "root.sport_events"), "event schedules")
    wrapped = rows.select(
        payload_file(payloads), aware_timestamp(F.col("root.generated_at")).alias("generated_at"), F.posexplode(listed).alias("position", "w")
    )
    fields = [part.split(":")[0] for part in ("id", "start_time", "scheduled", "status", "name", "competitors",
                                              "sport_event_context", "sport", "competition", "tournament")]
    bare = F.struct(*[F.col("w")[f].alias(f) for f in fields])
    e = F.col("e")
    context = e["sport_event_context"]
    sport = F.coalesce(context["sport"], e["sport"])
    competition = _names(F.coalesce(context["competition"], e["competition"], e["tournament"]))
    rival = lambda c: F.struct(  # noqa: E731 - a column lambda used twice
        blank_to_null(c["id"]).alias("source_id"),
        blank_to_null(c["qualifier"]).alias("role"),
        F.lit(None).cast("int").alias("position"),
        F.when(
            blank_to_null(c["name"]).isNotNull(),
            F.struct(
                blank_to_null(c["id"]).alias("source_id"),
                blank_to_null(c["name"]).alias("name"),
                F.lit(None).cast("string").alias("participant_type"),
            ),
        ).alias("participant"),
    )
    none = F.array().cast("array<struct<id:string,name:string,qualifier:string>>")
    people = F.filter(F.transform(F.coalesce(e["competitors"], none), rival), lambda p: p["source_id"].isNotNull())
    raw_status = F.coalesce(blank_to_null(e["status"]), F.lit("unknown"))
    names = F.filter(F.transform("participants", lambda p: p["participant"]["name"]), lambda n: n.isNotNull())
    out = (
        wrapped.withColumn("e", F.coalesce(F.col("w.sport_event"), bare))
        .withColumn("participants", once(people))
        .withColumn("source_id", blank_to_null(e["id"]))
        .withColumn("start_time", once(F.coalesce(aware_timestamp(e["start_time"]), aware_timestamp(e["scheduled"]))))
        .withColumn("sport_source_id", F.coalesce(blank_to_null(sport["id"]), F.lit(sport_source_id).cast("string")))
        .withColumn("c", competition)
        .withColumn("competition_source_id", F.coalesce(F.col("c.id"), F.lit(competition_source_id).cast("string")))
        .withColumn("status", F.coalesce(lookup(_STATUS, F.lower(raw_status)), F.lit("unknown")))
        .filter("source_id IS NOT NULL AND start_time IS NOT NULL AND sport_source_id IS NOT NULL")
    )
    if since is not None:
        out = out.filter(F.col("start_time") >= since)
    details = F.when(
        F.col("c.id").isNotNull() & F.col("c.name").isNotNull(),
        F.struct(
            F.col("c.id").alias("source_id"), F.col("sport_source_id"), F.col("c.name").alias("name"),
            F.lit(None).cast("string").alias("country_code"), F.lit(None).cast("string").alias("season"),
        ),
    )
    return out.select(
        "source_id",
        "sport_source_id",
        "competition_source_id",
        details.alias("competition"),
        F.coalesce(blank_to_null(e["name"]), F.nullif(F.array_join(names, " - "), F.lit(""))).alias("name"),
        "participants",
        "start_time",
        "status",
        (F.col("status") == "live").alias("is_live"),
        F.col("generated_at").alias("source_updated_at"),
        text_map(provider=F.lit(book.provider), book=F.lit(book.name), source_status=raw_status).alias("metadata"),
        "payload_file",
        "position",
    )


def _clean_outcome(outcome: Column) -> Column:
    """Every raw field parsed once; later steps only compare parsed values."""
    return F.struct(
        F.coalesce(blank_to_null(outcome["external_outcome_id"]), blank_to_null(outcome["id"])).alias("source_id"),
        blank_to_null(outcome["type"]).alias("type"),
        provider_token(outcome["type"]).alias("token"),
        blank_to_null(outcome["player_name"]).alias("player"),
        lenient_decimal(outcome["odds_decimal"]).alias("odds"),
        lenient_decimal(outcome["handicap"]).alias("handicap"),
        lenient_decimal(outcome["spread"]).alias("spread"),
        lenient_decimal(outcome["total"]).alias("total"),
        lenient_boolean(outcome["removed"], False).alias("removed"),
    )


def _selection(outcome: Column, removed: Column, generated_at: Column) -> Column:
    available = ~removed & ~outcome["removed"] & F.coalesce(outcome["odds"] > 1, F.lit(False))
    return F.struct(
        outcome["source_id"].alias("source_id"),
        F.coalesce(outcome["type"], outcome["player"], outcome["source_id"]).alias("label"),
        outcome["type"].alias("selection_type"),
        F.lit(None).cast("string").alias("participant_source_id"),
        F.coalesce(outcome["handicap"], outcome["spread"], outcome["total"]).alias("line"),
        F.struct(
            F.when(available, outcome["odds"]).alias("decimal_odds"),
            available.alias("is_available"),
            generated_at.alias("source_updated_at"),
        ).alias("price"),
        outcome["token"].alias("token"),
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, by a one-element transform."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def market_meaning(name: Column, market_id: Column) -> Column:
    """``type/period`` from the provider's name and id; null when unsupported or contradictory."""
    by_name = lookup({k: "/".join(v) for k, v in _NAME_MEANING.items()}, provider_token(name))
    number = numeric_id_suffix(market_id)

    def looked_up(n: Column) -> Column:
        by_id = lookup({k: "/".join(v) for k, v in _ID_MEANING.items()}, n["number"])
        return F.struct(n["by_name"].alias("by_name"), by_id.alias("by_id"), n["number"].isin(_UNSUPPORTED_IDS).alias("unsupported"))

    def meant(m: Column) -> Column:
        clash = m["by_name"] != m["by_id"]
        return F.when(~(F.coalesce(m["unsupported"], F.lit(False)) | F.coalesce(clash, F.lit(False))), F.coalesce(m["by_id"], m["by_name"]))

    return _bound(F.struct(by_name.alias("by_name"), number.alias("number")), lambda n: _bound(looked_up(n), meant))


def _lines(outcomes: Column, types: list[str], field: str) -> Column:
    """Distinct lines of the cleaned outcomes of the given types."""
    chosen = F.filter(outcomes, lambda o: o["token"].isin(types) & o[field].isNotNull())
    return F.array_distinct(F.transform(chosen, lambda o: o[field]))


def total_line(outcomes: Column) -> Column:
    return _bound(_lines(outcomes, ["over", "under"], "total"), lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def spread_line(outcomes: Column) -> Column:
    def agreed(v: Column) -> Column:
        h, a = F.get(v["home"], F.lit(0)), F.get(v["away"], F.lit(0))
        return F.when((F.size(v["home"]) == 1) & (F.size(v["away"]) == 1) & (h == -a), h)

    sides = F.struct(_lines(outcomes, ["home"], "spread").alias("home"), _lines(outcomes, ["away"], "spread").alias("away"))
    return _bound(sides, agreed)


def _carries_line(outcomes: Column) -> Column:
    return F.exists(outcomes, lambda o: F.coalesce(o["handicap"], o["spread"], o["total"]).isNotNull())


def _meant_selection(selection: Column, outcomes: Column, market_type: Column) -> Column:
    """Selection with its type limited to what the market allows and its line by market type.

    Its own outcome is found by source id, or by type where that type occurs once.
    """
    same_id = F.filter(outcomes, lambda o: o["source_id"] == selection["source_id"])
    same_type = F.filter(outcomes, lambda o: o["token"] == selection["token"])
    only = _bound(same_type, lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))
    return _bound(F.coalesce(F.get(same_id, F.lit(0)), only), lambda raw: _from_outcome(selection, raw, market_type))


def _from_outcome(selection: Column, raw: Column, market_type: Column) -> Column:
    kind = F.coalesce(raw["token"], selection["token"])
    allowed = F.lit(False)
    for name, kinds in _ALLOWED.items():
        allowed = allowed | ((market_type == name) & F.coalesce(kind.isin(kinds), F.lit(False)))
    line = (
        F.when(market_type == "moneyline", F.lit(None).cast(PRICE))
        .when(raw.isNull(), selection["line"])
        .when(market_type == "total", raw["total"])
        .otherwise(raw["spread"])
    )
    return _selection_struct(selection, F.when(allowed, kind), line)


def _selection_struct(selection: Column, kind: Column, line: Column) -> Column:
    return F.struct(
        selection["source_id"].alias("source_id"),
        selection["label"].alias("label"),
        kind.alias("selection_type"),
        selection["participant_source_id"].alias("participant_source_id"),
        line.alias("line"),
        selection["price"].alias("price"),
    )


def _unmeant_selection(selection: Column) -> Column:
    return _selection_struct(selection, F.lit(None).cast("string"), selection["line"])


def markets(payloads: DataFrame, book: Book) -> DataFrame:
    """SourceMarket rows of the wanted book. Outcomes stay arrays: no shuffle in the whole scan."""
    rows = parsed_object(
        payloads,
        f"generated_at:STRING,sport_event:STRUCT<id:STRING>,"
        f"markets:ARRAY<STRUCT<id:STRING,name:STRING,books:ARRAY<{_BOOK}>>>",
        "markets",
    )
    event_id = F.col("event_source_id") if "event_source_id" in payloads.columns else blank_to_null(F.col("root.sport_event.id"))
    listed = rows.select(
        payload_file(payloads),
        event_id.alias("event_source_id"),
        aware_timestamp(F.col("root.generated_at")).alias("generated_at"),
        F.posexplode(required(F.col("root.markets"), "markets")).alias("position", "m"),
    )
    chosen = F.get(F.filter("m.books", lambda b: book.matches(b)), F.lit(0))
    no_outcomes = F.array().cast(f"array<{_OUTCOME.lower()}>")
    books = listed.withColumn("b", once(chosen)).filter("b IS NOT NULL")
    cleaned = books.select(
        "payload_file",
        "event_source_id",
        "generated_at",
        "position",
        "b",
        blank_to_null(F.col("m.id")).alias("provider_id"),
        blank_to_null(F.col("m.name")).alias("name"),
        blank_to_null(F.col("b.external_market_id")).alias("external_id"),
        lenient_boolean(F.col("b.removed"), False).alias("removed"),
        once(F.transform(F.coalesce(F.col("b.outcomes"), no_outcomes), _clean_outcome)).alias("outcomes"),
        once(market_meaning(F.col("m.name"), F.col("m.id"))).alias("meaning"),
    )
    measured = cleaned.select(
        "*",
        F.coalesce("external_id", "provider_id").alias("source_id"),
        once(
            F.filter(
                F.transform("outcomes", lambda o: _selection(o, F.col("removed"), F.col("generated_at"))),
                lambda s: s["label"].isNotNull(),
            )
        ).alias("selections"),
        F.substring_index("meaning", "/", 1).alias("type"),
        once(
            F.struct(
                _carries_line(F.col("outcomes")).alias("any"),
                total_line(F.col("outcomes")).alias("total"),
                spread_line(F.col("outcomes")).alias("spread"),
            )
        ).alias("lines"),
    ).filter("source_id IS NOT NULL AND (size(selections) > 0 OR removed)")
    line = F.when(F.col("type") == "total", F.col("lines.total")).when(F.col("type") == "spread", F.col("lines.spread"))
    safe = F.when(F.col("type") == "moneyline", ~F.col("lines.any")).otherwise(line.isNotNull())
    judged = measured.select("*", line.alias("market_line"), F.coalesce(safe, F.lit(False)).alias("safe"))
    parsed = judged.withColumn("market_type", F.when(F.col("safe"), F.col("type")))
    return parsed.select(
        "source_id",
        "event_source_id",
        "name",
        "market_type",
        F.when(F.col("safe"), F.substring_index("meaning", "/", -1)).alias("period"),
        F.lit(None).cast("string").alias("scope"),
        F.when(F.col("safe"), F.col("market_line")).cast(PRICE).alias("line"),
        F.when(F.col("removed"), "suspended").otherwise("open").alias("status"),
        once(
            F.when(
                F.col("safe"),
                F.transform("selections", lambda s: _meant_selection(s, F.col("outcomes"), F.col("market_type"))),
            ).otherwise(F.transform("selections", _unmeant_selection))
        ).alias("selections"),
        F.col("generated_at").alias("source_updated_at"),
        text_map(
            provider=F.lit(book.provider),
            book_id=F.coalesce(blank_to_null(F.col("b.id")), F.lit(book.id)),
            book_name=F.coalesce(blank_to_null(F.col("b.name")), F.lit(book.name)),
            provider_market_id=F.col("provider_id"),
            external_market_id=F.col("external_id"),
            external_event_id=blank_to_null(F.col("b.external_sport_event_id")),
            skipped_outcomes=F.size("outcomes") - F.size("selections"),
        ).alias("metadata"),
        "payload_file",
        "position",
    )
