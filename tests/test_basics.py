"""Normalisation, scores, keys, similarity join, history and remapping on small input."""

import random
import tempfile
import uuid
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import pytest
import sequential as model
from pyspark.sql import functions as F

from fairline.functions import keys, scalars, text
from fairline.functions.similarity import fixed_point, score_text
from fairline.operators import history, merge, quality
from fairline.operators.matching import match_names
from fairline.operators.name_join import Floor, distinct_names, similar_names
from fairline.operators.rules import COMPETITION, PARTICIPANT
from fairline.schemas import TABLES
from fairline.streaming import quotes as stream


def test_names_and_tokens(spark):
    values = ["  Paris—Saint‑Germain FC ", "Catanìa", "Straße!", "ﬁve ½ Ａ", "A_b\tc", "ＩＮＴＥＲ", "a b", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = text.with_normalized_name(df, "v", "s", "f").select("v", "s", "f", text.normalized_token(F.col("v")).alias("t")).collect()
    for r in rows:
        assert r.s == text.strict_name(r.v) and r.f == text.folded_name(r.s) and r.t == (text.token_text(r.v) or None)
    assert {r.v: r.s for r in rows}["  Paris—Saint‑Germain FC "] == "paris saint germain fc"


def test_seasons_and_countries(spark):
    cases = {"2026/27": "2026-2027", "1999–00": "1999-2000", "2026": "2026", " 2026 / 2027 ": "2026-2027", "x  y": "x y", " ": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.season(F.col("v")).alias("s"))
    assert {r.v: r.s for r in df.collect()} == cases
    codes = {" it ": "IT", "ITA": None, "1T": None, "É1": None}
    df = spark.createDataFrame([(k,) for k in codes], "v string").select("v", text.country_code(F.col("v")).alias("c"))
    assert {r.v: r.c for r in df.collect()} == codes


def test_lenient_values(spark):
    df = spark.createDataFrame([("2.10", "true", "7"), ("x", "maybe", "7.5"), (None, "FALSE ", "true")], "d string, b string, i string")
    rows = df.select(
        scalars.lenient_decimal(F.col("d")).alias("d"), scalars.lenient_boolean(F.col("b"), True).alias("b"), scalars.lenient_integer(F.col("i")).alias("i")
    ).collect()
    assert [tuple(r) for r in rows] == [(Decimal("2.1"), True, 7), (None, True, None), (None, False, None)]
    stamps = {"2026-09-09T15:00:30Z": True, "2026-09-09T15:00:30": False, "2026-09-09T15:00:30+0200": True, "soon": False}
    df = spark.createDataFrame([(k,) for k in stamps], "v string").select("v", scalars.aware_timestamp(F.col("v")).isNotNull().alias("ok"))
    assert {r.v: r.ok for r in df.collect()} == stamps


def test_scores_are_exact(spark):
    cases = [(11, 14), (2, 3), (1, 1), (97, 100), (123455, 1000000), (123465, 1000000)]
    df = spark.createDataFrame(cases, "n int, d int").select("n", "d", fixed_point(F.col("n"), F.col("d")).alias("u"))
    for r in df.select("*", score_text(F.col("u")).alias("t")).collect():
        assert r.u == 10**18 * r.n // r.d
        assert r.t == (Decimal(r.u) / 10**18).quantize(Decimal("0.00001"))


def test_keys(spark):
    t = datetime(2026, 9, 9, 12, 0, tzinfo=UTC)
    df = spark.createDataFrame([("b", "s", "2.10", t, t), ("b", "s", "2.100", t + timedelta(hours=1), t), ("b", "s", "2.2", t, t)], "b string, s string, o string, seen timestamp, at timestamp")
    rows = df.select(keys.observation_key(F.col("b"), F.col("s"), F.col("o").cast("decimal(18,8)"), F.lit(True), F.col("seen"), F.col("at")).alias("k")).collect()
    assert rows[0].k == rows[1].k != rows[2].k
    made = spark.range(1).select(keys.canonical_id(F.lit("bk"), "event", F.lit("ü1")).alias("u")).first().u
    assert made == str(uuid.uuid5(uuid.UUID(keys.CANONICAL_NAMESPACE), "bk:event:ü1"))


@pytest.mark.parametrize("floor", [Floor(5, 8), Floor(37, 70)])
def test_similarity_join_finds_every_pair(spark, floor):
    random.seed(5)
    words = ["fc", "ac", "inter", "milan", "united", "city", "real", "a", "ab", "internazionale", "san", "é"]

    def name():
        made = " ".join(random.sample(words, random.randint(1, 3)))
        if random.random() < 0.5:
            place = random.randrange(len(made))
            made = made[:place] + random.choice("abxyz") + made[place + 1 :]
        return " ".join(made.split())

    def side():
        rows = {(random.choice("fg"), n) for n in (name() for _ in range(120)) if n}
        df = text.with_normalized_name(spark.createDataFrame(sorted(rows), "sport string, name string"), "name", "s", "f")
        return rows, distinct_names(df, "sport", "s", "f")

    (left, left_df), (right, right_df) = side(), side()
    expected = {}
    for block, a in left:
        for other, b in right:
            if block == other and (value := model.similarity(a, b)) >= Fraction(floor.num, floor.den):
                expected[(block, a, b)] = value
    found = {(r.block, r.left_name, r.right_name): Fraction(r.num, r.den) for r in similar_names(left_df, right_df, floor).collect()}
    assert found == expected


PERSON = "id string, sport_id string, name string, participant_type string, country_code string"


def test_participant_goldens(spark):
    sources = spark.createDataFrame([("a", "f", "Inter", "team", None), ("b", "f", "United City", "team", None), ("c", "f", "Inter", None, None), ("d", "f", "?!", None, None)], PERSON.replace("id ", "source_id ", 1))
    stored = spark.createDataFrame([("1", "f", "Internazionale Milano", "team", None), ("2", "f", "United City", "team", None), ("3", "f", "United-City", "team", None), ("4", "f", "Juve", "player", None)], PERSON)
    aliases = spark.createDataFrame([("1", "Inter")], "entity_id string, alias string")
    rows = {r.source_id: r for r in match_names(sources, stored, aliases, PARTICIPANT).collect()}
    assert (rows["a"].state, rows["a"].canonical_id, rows["a"].hard_rejection_reasons) == ("matched", "1", {"participant_type_conflict": 1})
    assert (rows["b"].state, rows["b"].reason_code, rows["b"].plausible_candidate_count) == ("ambiguous", "insufficient_margin", 2)
    assert (rows["c"].reason_code, rows["c"].best_score) == ("plausible_candidate_below_auto_threshold", Decimal("0.90000"))
    assert (rows["d"].state, rows["d"].reason_code) == ("rejected", "invalid_name")


def test_competition_goldens(spark):
    shape = "id string, sport_id string, name string, country_code string, season string, gender string"
    sources = spark.createDataFrame([("a", "f", "SERIE-A", "it", "2026/27", None), ("b", "f", "Serie A", "BR", None, None)], shape.replace("id ", "source_id ", 1))
    stored = spark.createDataFrame([("1", "f", "Serie A", "IT", "2026-2027", None)], shape)
    rows = {r.source_id: r for r in match_names(sources, stored, None, COMPETITION).collect()}
    assert (rows["a"].state, rows["a"].runner_up_score) == ("matched", Decimal("0.00000"))
    assert (rows["b"].state, rows["b"].hard_rejection_count) == ("created", 1)


def test_history_windows_cross_slices(spark):
    random.seed(3)
    start = datetime(2026, 1, 1, tzinfo=UTC)
    rows = [(random.choice("ab"), start + timedelta(hours=7 * i), i, random.choice([None, "1.5", "2.0"])) for i in range(120)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, n int, o string").select(
        "s", "ts", "n", F.col("o").cast("decimal(18,8)").alias("decimal_odds"), F.col("o").isNotNull().alias("is_available")
    )
    kept, last = [], {}
    for s, _, n, o in rows:
        if s not in last or last[s] != o:
            kept.append(n)
        last[s] = o
    assert sorted(r.n for r in history.change_only(df, ["s"], "ts", ["ts", "n"]).collect()) == kept
    probes = spark.createDataFrame([("a", start + timedelta(hours=h)) for h in range(0, 900, 50)], "s string, asked timestamp")
    found = {r.asked: r.quote and r.quote.n for r in history.as_of_join(probes, df, ["s"], "asked", ["ts", "n"], ["decimal_odds"]).collect()}
    for asked, n in found.items():
        earlier = [r[2] for r in rows if r[0] == "a" and r[1] <= asked.astimezone(UTC)]
        assert n == (max(earlier) if earlier else None)


def test_mapping_conflicts_are_reported(spark):
    t = datetime(2026, 1, 1, tzinfo=UTC)
    row = ("i", "b", "event", "s", "c1", "n", t, t, None)
    table = spark.createDataFrame([row], TABLES["source_entity_mappings"])
    moved = spark.createDataFrame([("j", "b", "event", "s", "c2", "n", t, t, None)], TABLES["source_entity_mappings"])
    _, conflicts = merge.upsert_mappings(table, moved)
    assert conflicts.count() == 1
    touched, conflicts = merge.upsert_mappings(table, spark.createDataFrame([row[:5] + ("new", t, t + timedelta(days=1), None)], TABLES["source_entity_mappings"]))
    (only,) = touched.collect()
    assert conflicts.count() == 0 and (only.source_name, only.first_seen_at < only.last_seen_at) == ("new", True)


def test_row_checks(spark):
    df = spark.createDataFrame([("a", "2.0", True), (" b", None, True), ("c", "2.0", False)], "id string, o string, ok boolean")
    rules = {"id": quality.bad_id(F.col("id")), "price": quality.bad_price(F.col("o").cast("decimal(18,8)"), F.col("ok"))}
    assert {r.id: sorted(r.broken) for r in quality.violations(df, rules).collect()} == {" b": ["id", "price"], "c": ["price"]}
    assert {r.rule: (r.checked, r.broken) for r in quality.report(df, rules).collect()} == {"id": (3, 1), "price": (3, 2)}


def test_changes_across_micro_batches(spark):
    folder = tempfile.mkdtemp(prefix="run-stream-")
    schema = "s string, ts timestamp, n int, decimal_odds decimal(18,8), is_available boolean"
    start = datetime(2026, 1, 1, tzinfo=UTC)

    def land(numbers, price):
        rows = [("a", start + timedelta(minutes=n), n, Decimal(price), True) for n in numbers]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        query = stream.change_stream(
            spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", f"{folder}/progress", ["s"], "ts", ["ts", "n"]
        )
        query.awaitTermination()

    land([1, 2], "1.5")
    land([3], "1.5")
    land([4, 5], "2.0")
    assert sorted(r.n for r in stream.read_changes(spark, f"{folder}/out", ["s"]).collect()) == [1, 4]


def test_late_quotes_land_and_change_what_follows(spark):
    """Three one-file batches: quotes that come days late are appended, and the changes equal those of one batch."""
    folder = tempfile.mkdtemp(prefix="run-stream-")
    schema = "observation_key string, s string, ts timestamp, n int, decimal_odds decimal(18,8), is_available boolean"
    day = lambda d, h=0: datetime(2026, 3, d, h, tzinfo=UTC)
    rows = [("p", day(10), 3, "2.5"), ("q", day(11), 4, "4.0"), ("late", day(1), 1, "2.5"), ("late2", day(10, 9), 5, "4.0"), ("p", day(10), 3, "2.5"), ("last", day(2), 2, "3.0")]

    def run(name):
        read = lambda: spark.readStream.schema(schema).parquet(f"{folder}/in")
        stream.append_stream(read(), f"{folder}/history", f"{folder}/{name}", ["ts", "n"], time="ts").awaitTermination()
        stream.change_stream(read(), f"{folder}/out", f"{folder}/state", f"{folder}/progress", ["s"], "ts", ["ts", "n"]).awaitTermination()

    seen = []
    for part in (rows[:2], rows[2:3], rows[3:]):
        spark.createDataFrame([(k, "a", t, n, Decimal(o), True) for k, t, n, o in part], schema).write.mode("append").parquet(f"{folder}/in")
        run("progress-history")
        seen += [r for r in part if r not in seen]
        got = sorted({r.observation_key for r in stream.read_changes(spark, f"{folder}/out", ["s"]).collect()})
        batch = spark.createDataFrame([(k, "a", t, n, Decimal(o), True) for k, t, n, o in seen], schema)
        assert got == sorted(r.observation_key for r in history.change_only(batch, ["s"], "ts", ["ts", "n"]).collect())
    run("replayed")
    assert sorted(r.observation_key for r in spark.read.parquet(f"{folder}/history").collect()) == ["last", "late", "late2", "p", "q"]
