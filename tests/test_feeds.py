"""Feed parsing on small payloads."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fairline.sources import keyed_feed, nested_feed, payloads

BOOK = nested_feed.Book(id="sr:book:40417", name="Wanted Book")


def payload(spark, *documents):
    return spark.createDataFrame([(json.dumps(d),) for d in documents], "payload string")


def outcome(kind=None, odds=None, **more):
    return {k: v for k, v in {"type": kind, "odds_decimal": odds, **more}.items() if v is not None}


def book(outcomes, **more):
    return {"id": "sr:book:40417", "name": "Wanted", "outcomes": outcomes, **more}


def market_payload(*markets):
    return {"generated_at": "2027-02-05T08:12:44Z", "sport_event": {"id": "sr:sport_event:1"}, "markets": list(markets)}


def one_market(spark, name, outcomes, market_id="sr:market:7777", **more):
    rows = nested_feed.markets(
        payload(spark, market_payload({"id": market_id, "name": name, "books": [book(outcomes, external_market_id="m", **more)]})), BOOK
    ).collect()
    return rows[0]


def test_nested_sports_and_coverage(spark):
    doc = {"sports": [{"id": "sr:sport:1", "name": "Handball", "type": "team"}, {"id": "sr:sport:2", "name": "Rugby"}, {"name": "x"}]}
    rows = nested_feed.sports(payload(spark, doc), BOOK).orderBy("source_id").collect()
    assert [(r.source_id, r.name, r.code) for r in rows] == [("sr:sport:1", "Handball", None), ("sr:sport:2", "Rugby", None)]
    assert rows[0].metadata["provider_type"] == "team"
    books = {"books": [{"id": "sr:book:1", "name": "Other"}, {"id": "x:40417", "name": "?"}]}
    assert nested_feed.coverage(payload(spark, books), BOOK).first().healthy
    assert nested_feed.coverage(payload(spark, {"books": [{"name": "WANTED BOOK"}]}), BOOK).first().healthy
    assert not nested_feed.coverage(payload(spark, {"books": []}), BOOK).first().healthy


def test_nested_events(spark):
    wrapped = {
        "sport_event": {
            "id": "sr:sport_event:7312", "start_time": "2027-02-06T14:20:00+00:00", "status": "not_started",
            "competitors": [{"id": "c10", "name": "Harbour Town", "qualifier": "home"}, {"id": "c20", "name": "Mill Lane", "qualifier": "away"}],
            "sport_event_context": {"sport": {"id": "sr:sport:1"}, "competition": {"id": "sr:competition:404", "name": "Coast League"}},
        }
    }
    bare = {"id": "e2", "scheduled": "2027-02-07T14:20:00Z", "status": "1st_half", "sport": {"id": "s"}, "tournament": {"id": "t"}}
    no_start = {"id": "e3", "start_time": "2027-02-07T14:20:00", "sport": {"id": "s"}}
    rows = nested_feed.events(payload(spark, {"generated_at": "2027-02-05T08:12:44Z", "schedules": [wrapped, bare, no_start]}), BOOK)
    first, second = rows.orderBy("position").collect()
    assert (first.source_id, first.name, first.status, first.is_live) == ("sr:sport_event:7312", "Harbour Town - Mill Lane", "scheduled", False)
    assert [p.role for p in first.participants] == ["home", "away"]
    assert (first.competition_source_id, first.competition.name) == ("sr:competition:404", "Coast League")
    assert (second.status, second.is_live, second.competition_source_id, second.competition, second.name) == ("live", True, "t", None, None)
    late = nested_feed.events(payload(spark, {"sport_events": [wrapped, bare]}), BOOK, since=F.lit("2027-02-07").cast("timestamp"))
    assert [r.source_id for r in late.collect()] == ["e2"]


def test_nested_root_must_be_an_array(spark):
    assert nested_feed.events(payload(spark, {"schedules": []}), BOOK).collect() == []
    for bad in ({"other": []}, {"schedules": "x"}):
        with pytest.raises(Exception, match="event schedules"):
            nested_feed.events(payload(spark, bad), BOOK).collect()


def test_nested_markets(spark):
    doc = market_payload(
        {
            "id": "sr:market:1", "name": "3way",
            "books": [
                {"id": "sr:book:5", "name": "Other", "outcomes": [outcome("home", "9.0", id="z")]},
                book(
                    [outcome("home", "1.85", external_outcome_id="o-h"), outcome("draw", "3.70", id="d", removed=True),
                     outcome("away", "4.15", id="sr:outcome:away"), {"odds_decimal": "5.0"}],
                    external_market_id="b-1",
                ),
            ],
        },
        {"id": "sr:market:3", "name": "total", "books": [book([outcome("over", "1.9", total="2.5", id="a"), outcome("under", "1.9", total=2.5, id="b")],
                                                             external_market_id="closed-7", removed=True)]},
        {"name": "broken"},
    )
    first, second = nested_feed.markets(payload(spark, doc), BOOK).orderBy("position").collect()
    assert (first.source_id, first.status, first.market_type, first.period, first.line) == ("b-1", "open", "moneyline", "full_time", None)
    assert first.metadata["skipped_outcomes"] == "1"
    assert [(s.source_id, s.selection_type, s.price.decimal_odds, s.price.is_available) for s in first.selections] == [
        ("o-h", "home", Decimal("1.85000000"), True), ("d", "draw", None, False), ("sr:outcome:away", "away", Decimal("4.15000000"), True)]
    assert (second.source_id, second.status, second.market_type, second.line) == ("closed-7", "suspended", "total", Decimal("2.5"))
    assert [(s.line, s.price.decimal_odds) for s in second.selections] == [(Decimal("2.5"), None)] * 2


@pytest.mark.parametrize(
    ("name", "market_id", "outcomes", "expected"),
    [
        ("anything", "sr:market:1", [outcome("home", "2", id="h")], ("moneyline", "full_time", None, ["home"], [None])),
        ("spread", "x", [outcome("home", "2", id="h", spread="-1.5"), outcome("away", "2", id="a", spread="1.5")],
         ("spread", "full_time", Decimal("-1.5"), ["home", "away"], [Decimal("-1.5"), Decimal("1.5")])),
        ("spread", "x", [outcome("home", "2", id="h", spread="-1.5"), outcome("away", "2", id="a", spread="2.5")],
         (None, None, None, [None, None], [Decimal("-1.5"), Decimal("2.5")])),
        ("Half With Most Goals", "999", [outcome("1-0", "7.00", id="h")], (None, None, None, [None], [None])),
        ("total", "sr:market:1", [outcome("over", "2", id="h", total="2.5")], (None, None, None, [None], [Decimal("2.5")])),
        ("total", "x", [outcome("over", "2", id="h", total="2.5"), outcome("under", "2", id="u", total="2.75")],
         (None, None, None, [None, None], [Decimal("2.5"), Decimal("2.75")])),
        ("total", "sr:market:225", [outcome("over", "2", id="h", total="2.5")], (None, None, None, [None], [Decimal("2.5")])),
        ("1x2", "x", [outcome("home", "2", id="h", handicap="1")], (None, None, None, [None], [Decimal("1")])),
    ],
)
def test_nested_market_meaning(spark, name, market_id, outcomes, expected):
    row = one_market(spark, name, outcomes, market_id)
    assert (row.market_type, row.period, row.line, [s.selection_type for s in row.selections], [s.line for s in row.selections]) == expected


FIXTURE = {
    "fixtureId": "f1", "status": {"live": False, "statusId": 0}, "sport": {"sportId": 10, "sportName": "Handball"},
    "tournament": {"tournamentId": 838, "tournamentName": "Coast League"}, "season": {"seasonName": "2027/28"},
    "startTime": 1801923600,
    "participants": {"participant1Id": 61803, "participant1Name": "Harbour-Town", "participant2Id": 27182, "participant2Name": "Mill Lane."},
    "bookmakers": {"keyed": {"bookmaker": "keyed", "suspended": False, "staleOdds": False, "participantsRotated": False,
                             "updatedAt": "2027-02-05T08:10:00Z"}},
}


def quote(market, outcome_id, price, **more):
    return {"bookmaker": "keyed", "marketId": market, "outcomeId": outcome_id, "price": price, "active": True, "marketActive": True,
            "bookmakerChangedAt": 1801912364000, **more}


ODDS = {
    "q1": quote(101, 101, 1.83, bookmakerMarketId="m-1x2", bookmakerOutcomeId="home"),
    "q2": quote(101, 102, 3.72, bookmakerMarketId="m-1x2", bookmakerOutcomeId="draw"),
    "q3": quote(101, 103, 4.11, bookmakerMarketId="m-1x2"),
    "q4": quote(104, 104, 2.02, marketActive=False),
    "q5": {"bookmaker": "keyed", "outcomeId": 1},
}
DEFINITIONS = [
    {"marketId": 101, "marketType": "1x2", "period": "fulltime", "handicap": 0, "marketName": "Full Time Result",
     "outcomes": [{"outcomeId": 101, "outcomeName": "1"}, {"outcomeId": 102, "outcomeName": "X"}, {"outcomeId": 103, "outcomeName": "2"}]},
    {"marketName": "no id"},
]


def keyed_markets(spark, **meta):
    doc = json.loads(json.dumps(FIXTURE))
    doc["bookmakers"]["keyed"].update(meta)
    doc["odds"] = {"keyed": ODDS, "other": {"z": quote(101, 101, 9)}}
    return keyed_feed.markets(payload(spark, doc), payload(spark, DEFINITIONS), "keyed").orderBy("position").collect()


def test_keyed_events(spark):
    live = dict(FIXTURE, fixtureId="f2", status={"live": True, "statusId": 0})
    unknown_status = dict(FIXTURE, fixtureId="f4", status={"statusId": 0})
    alone = dict(FIXTURE, fixtureId="f3", participants={"participant1Id": 1})
    rows = keyed_feed.events(payload(spark, [FIXTURE, live, alone, unknown_status]), "keyed").collect()
    (row,) = rows
    assert (row.source_id, row.name, row.status, row.competition.season) == ("f1", "Harbour-Town - Mill Lane.", "scheduled", "2027/28")
    assert [(p.source_id, p.role, p.position) for p in row.participants] == [("61803", None, 1), ("27182", None, 2)]
    assert keyed_feed.events(payload(spark, [FIXTURE]), "someone").collect() == []


def test_keyed_markets(spark):
    first, second = keyed_markets(spark)
    assert (first.source_id, first.name, first.market_type, first.period, first.status) == ("m-1x2", "Full Time Result", "moneyline", "full_time", "open")
    assert [(s.source_id, s.label, s.selection_type, s.participant_source_id, s.price.decimal_odds) for s in first.selections] == [
        ("home", "1", "home", "61803", Decimal("1.83")), ("draw", "X", "draw", None, Decimal("3.72")), ("q3", "2", "away", "27182", Decimal("4.11"))]
    assert first.metadata["skipped_quotes"] == "1"
    assert (second.source_id, second.status, second.market_type) == ("104", "suspended", None)
    assert [(s.price.decimal_odds, s.price.is_available) for s in second.selections] == [(None, False)]


def test_keyed_stale_and_unknown_rotation(spark):
    first, _ = keyed_markets(spark, staleOdds=True)
    assert {s.price.is_available for s in first.selections} == {False}
    assert first.metadata["stale_odds"] == "true" and first.selections[0].price.source_updated_at is not None
    first, _ = keyed_markets(spark, participantsRotated=None)
    assert first.market_type is None and {s.selection_type for s in first.selections} == {None}
    with pytest.raises(Exception, match="suspended flag"):
        keyed_markets(spark, suspended="no")


def test_keyed_gates(spark):
    doc = dict(FIXTURE, odds={"keyed": ODDS})
    asked = payload(spark, doc).withColumn("event_source_id", F.lit("other"))
    with pytest.raises(Exception, match="changed fixtureId"):
        keyed_feed.quotes(asked, "keyed").collect()
    with pytest.raises(Exception, match="fixtures"):
        keyed_feed.events(payload(spark, {"a": 1}), "keyed").collect()
    with pytest.raises(ValueError):
        keyed_feed.numeric_id("-5", "sport_source_id")
    assert keyed_feed.coverage(payload(spark, [{"slug": "keyed", "active": True}]), "keyed").first().healthy
    assert not keyed_feed.coverage(payload(spark, [{"slug": "keyed"}]), "keyed").first().healthy
    assert [r.source_id for r in keyed_feed.sports(payload(spark, [{"sportId": 10, "sportName": "Handball"}, {"sportName": "x"}])).collect()] == ["10"]


def test_bad_payloads_are_set_aside(spark):
    good = {"schedules": [{"sport_event": {"id": "e1", "start_time": "2027-02-06T14:20:00Z", "sport": {"id": "s"}}}]}
    rows = [(json.dumps(good),), ("{",), ("[]",), ('{"schedules": "x"}',), (None,), ('{"other": []}',)]
    landed = spark.createDataFrame(rows, "payload string")
    sound, rejected = payloads.sound_and_rejected(landed, payloads.object_problem("schedules", "sport_events"))
    assert [r.source_id for r in nested_feed.events(sound, BOOK).collect()] == ["e1"]
    assert rejected.count() == 5 and rejected.filter("problem IS NULL").count() == 0
    listed = spark.createDataFrame([("[]",), ("[{}",), ("{}",), (None,)], "payload string")
    assert payloads.sound_and_rejected(listed, payloads.list_problem())[0].count() == 1


def test_bad_fixture_odds_are_set_aside_one_by_one(spark):
    def landed(asked, **changes):
        doc = {k: v for k, v in {**FIXTURE, "odds": {"keyed": ODDS}, **changes}.items() if v is not None}
        return json.dumps(doc), asked

    fixture = FIXTURE["fixtureId"]
    flagless = {"keyed": {k: v for k, v in FIXTURE["bookmakers"]["keyed"].items() if k != "suspended"}}
    rows = [landed(fixture), landed("other"), landed(fixture, bookmakers=flagless), landed(fixture, odds=None), ("[1]", fixture), (None, fixture)]
    asked = spark.createDataFrame(rows, "payload string, event_source_id string")
    sound, rejected = payloads.sound_and_rejected(asked, keyed_feed.odds_problem(asked, "keyed"))
    assert {r.problem.split(" is ")[0] for r in rejected.collect()} == {"fixture odds changed fixtureId", "book suspended flag", "odds", "the root"}
    assert rejected.count() == 5
    alone = keyed_feed.quotes(spark.createDataFrame(rows[:1], asked.schema), "keyed").count()
    assert keyed_feed.quotes(sound, "keyed").count() == alone > 0
