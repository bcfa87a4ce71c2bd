"""Canonical events of one shape are counted and listed in two shuffles; names are compared only where a score depends on them."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fairline.functions import text
from fairline.operators import event_matching as em

_START = datetime(2024, 1, 1, 12)
_PEOPLE = "array<struct<source_id:string,canonical_id:string,role:string,position:int>>"


def _events(spark, rows):
    people = [("a", "a", "Home", 1), ("b", "b", "away", 2)]
    full = [(i, "s", "tennis", c, name, people, _START + timedelta(minutes=m)) for i, c, name, m in rows]
    schema = f"id string, sport_id string, sport_code string, competition_id string, name string, participants {_PEOPLE}, start_time timestamp_ntz"
    return em.with_shape(spark.createDataFrame(full, schema))


def test_profiles_in_two_shuffles(spark):
    rows = [(f"{i:02}", "league", "A - B", 0) for i in range(7)] + [("x", None, "A - B", 0), ("y", "league", None, 5)]
    keyed = _events(spark, rows).withColumn("profile_id", em.class_key())
    profiles = em.event_profiles(keyed)
    plan = profiles._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "collect_list" not in plan
    got = sorted((r.n, r.ids) for r in profiles.collect())
    assert got == [(1, ["x"]), (1, ["y"]), (7, ["00", "01", "02", "03", "04"])]


def test_only_eligible_pairs_score(spark):
    profiles = em.event_profiles(_events(spark, [("p", "cup", "A B", 0), ("q", "league", "A B x", 1), ("r", "league", "a-b", 2), ("z", None, None, 3)]).withColumn("profile_id", em.class_key()))
    classes = _events(spark, [("c", "league", "A - B", 0)]).select(F.lit("c").alias("class_id"), *em.SHAPE)
    pairs = em.near_pairs(classes, profiles)
    assert pairs.columns == ["class_id", "profile_id", "n", "ids", "delta", "conflict", "risk", "score"]
    got = {r.ids[0]: (r.conflict, r.risk, r.score) for r in pairs.collect()}
    auto = 6 * 3600 * 1_000_000
    exact = lambda points, num, den, minutes: 10**18 * (points * auto * den - minutes * 60_000_000 * 125 * den + auto * 50 * num) // (auto * 1000 * den)
    assert got == {
        "p": ("competition_conflict", 0, None), "q": (None, 0, exact(950, 4, 5, 1)),
        "r": (None, 0, exact(950, 1, 1, 2)), "z": (None, 0, exact(900, 1, 2, 3)),
    }
    ranked = em.ranked_events(pairs).first()["candidates"]
    assert [(c["rank"], c["candidate_id"]) for c in ranked] == [(1, "r"), (2, "q"), (3, "z")]


def test_tokens_as_before(spark):
    values = [None, "", "_", "home", "Home ", "a b", "__x_", "Élan", "9", "a\n", "é", "x-1"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.t for r in rows.select("i", text.ascii_token(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [None, None, None, "home", "home", "a_b", "x", "élan", "9", "a", "é", "x_1"]
