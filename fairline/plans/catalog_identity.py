"""Registered queries over identity: normalisation, keys, matching, mappings, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairline.functions import keys, text
from fairline.functions.scalars import sport_code
from fairline.operators import event_matching, merge
from fairline.operators.matching import candidate_profiles, eligibility_counts, match_names, source_classes
from fairline.operators.remediate import remap
from fairline.operators.name_join import distinct_names, similar_names
from fairline.operators.resolve import resolve_names
from fairline.operators.rules import COMPETITION, PARTICIPANT, prepared_candidates, prepared_sources
from fairline.plans import readmodels, views
from fairline.plans.views import PARTICIPANT_ENTITIES_SQL, PARTICIPANT_SOURCES_SQL
from fairline.schemas import TABLES
from fairline.session import cut_lineage

_SEPARATORS = r"'[\p{P}\p{S}\p{Z}\s]+'"


def normalized_sql(expression: str) -> str:
    """J1 in SQL, for text whose compatibility forms and case folding are plain."""
    return f"trim(regexp_replace(replace(lower({expression}), 'ß', 'ss'), {_SEPARATORS}, ' ', 'g'))"


def uuid5_sql(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    variant = f"substr('89ab89ab89ab89ab', CAST(strpos('0123456789abcdef', substr({h}, 17, 1)) AS INTEGER), 1)"
    return (
        f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-', {variant}, "
        f"substr({h}, 18, 3), '-', substr({h}, 21, 12))"
    )


def similarity_sql(pairs: str) -> str:
    """Add num and den to a relation with ASCII names a and b."""
    return f"""
      SELECT *, CASE WHEN a = b THEN 1 WHEN lev_wins AND lev_num * 100 > lev_den * 97 OR NOT lev_wins AND dice_num * 100 > dice_den * 97
          THEN 97 WHEN lev_wins THEN lev_num ELSE dice_num END AS num,
        CASE WHEN a = b THEN 1 WHEN lev_wins AND lev_num * 100 > lev_den * 97 OR NOT lev_wins AND dice_num * 100 > dice_den * 97
          THEN 100 WHEN lev_wins THEN lev_den ELSE dice_den END AS den
      FROM (SELECT *, lev_num * dice_den >= dice_num * lev_den AS lev_wins FROM (
        SELECT *, greatest(length(a), length(b)) - levenshtein(a, b) AS lev_num, greatest(length(a), length(b)) AS lev_den,
          2 * len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) AS dice_num,
          len(list_distinct(string_split(a, ' '))) + len(list_distinct(string_split(b, ' '))) AS dice_den
        FROM ({pairs}) p))
    """


def normalize_names(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised form of every whole document, as a digest and a length."""
    documents = views.spread(views.table(spark, folder, "documents").select("doc_id", "text"))
    rows = text.with_normalized_name(documents, "text", "norm")
    return rows.select("doc_id", F.md5("norm").alias("norm_digest"), F.length("norm").alias("norm_length"))


_SEASON = (
    "CASE o_orderkey % 4 WHEN 0 THEN concat(substring({y}, 1, 4), '/', substring({n}, 3, 2)) "
    "WHEN 1 THEN concat(' ', {y}, ' – ', {n}, ' ') WHEN 2 THEN {y} ELSE concat('Season ', {y}) END"
)


def season_country_tokens(spark: SparkSession, folder: str) -> DataFrame:
    year, following = "date_format(o_orderdate, 'yyyy')", "CAST(year(o_orderdate) + 1 AS STRING)"
    return views.table(spark, folder, "orders").select(
        "o_orderkey",
        text.season(F.expr(_SEASON.format(y=year, n=following))).alias("season"),
        text.country_code(
            F.expr("CASE o_custkey % 4 WHEN 0 THEN ' it ' WHEN 1 THEN 'FR' WHEN 2 THEN 'ITA' ELSE '1T' END")
        ).alias("country"),
        text.normalized_token(F.col("o_orderpriority")).alias("token"),
        sport_code(F.lit(None).cast("string"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("code"),
    )


_TOKENS_SQL = f"""
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN y WHEN 3 THEN concat('Season ', y) ELSE concat(y, '-', n) END AS season,
    CASE o_custkey % 4 WHEN 0 THEN 'IT' WHEN 1 THEN 'FR' END AS country,
    trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9_]+', '_', 'g'), '_') AS token,
    array_to_string(list_filter(string_split(lower(o_orderpriority), ' '), lambda x: x <> ''), '-') AS code
  FROM (SELECT *, strftime(o_orderdate, '%Y') AS y, CAST(year(o_orderdate) + 1 AS VARCHAR) AS n FROM orders)
"""


def canonical_ids(spark: SparkSession, folder: str) -> DataFrame:
    book = F.concat(F.lit("book-"), (F.col("c_nationkey") % 5).cast("string"))
    source = F.col("c_custkey").cast("string")
    return views.table(spark, folder, "customer").select(
        "c_custkey",
        keys.canonical_id(book, "participant", source).alias("canonical_id"),
        keys.mapping_id(book, F.lit("participant"), source).alias("mapping_id"),
        keys.unnamed_selection_id(
            F.col("c_mktsegment"), F.lit(None).cast("string"), source, F.lit("2.500").cast("decimal(18,8)"), F.col("c_name")
        ).alias("selection_id"),
    )


_BOOK_SQL = "'book-' || CAST(c_nationkey % 5 AS VARCHAR) || ':participant:' || CAST(c_custkey AS VARCHAR)"
_IDS_SQL = f"""
  SELECT c_custkey, {uuid5_sql(keys.CANONICAL_NAMESPACE, _BOOK_SQL)} AS canonical_id,
    {uuid5_sql(keys.MATCHING_NAMESPACE, "'mapping:' || " + _BOOK_SQL)} AS mapping_id,
    {uuid5_sql(keys.CANONICAL_NAMESPACE, "'selection:' || c_mktsegment || '|unknown|' || CAST(c_custkey AS VARCHAR) || '|2.5|' || c_name")} AS selection_id
  FROM customer
"""


def decision_keys(spark: SparkSession, folder: str) -> DataFrame:
    prepared = prepared_sources(views.participant_sources(spark, folder), PARTICIPANT)
    key = keys.decision_key(F.col("bookmaker_id"), "participant", F.col("source_id"), F.col("source_fingerprint"))
    return prepared.select("source_id", "source_fingerprint", key.alias("decision_key"), keys.decision_id(key).alias("decision_id"))


_FINGERPRINT_SQL = f"""
  SELECT *, sha256('{{"country":null,"name":"' || {normalized_sql("name")} || '","sport_id":"' || sport_id || '","type":'
    || coalesce('"' || participant_type || '"', 'null') || '}}') AS source_fingerprint FROM ({PARTICIPANT_SOURCES_SQL}) s
"""
_DECISION_KEY_SQL = "sha256(concat_ws('|', bookmaker_id, 'participant', source_id, source_fingerprint, 'prematch-v1'))"
_DECISION_KEYS_SQL = f"""
  SELECT source_id, source_fingerprint, decision_key, {uuid5_sql(keys.MATCHING_NAMESPACE, "'decision:' || decision_key")} AS decision_id
  FROM (SELECT *, {_DECISION_KEY_SQL} AS decision_key FROM ({_FINGERPRINT_SQL}) f)
"""


def name_similarity_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five closest other spellings of every part name within its type."""
    named = text.with_normalized_name(views.participant_sources(spark, folder), "name", "norm_name", "folded_name")
    names = distinct_names(named, "sport_id", "norm_name", "folded_name")
    pairs = similar_names(names, names, PARTICIPANT.floor).filter("left_name <> right_name")
    score = F.col("num") * 1000000
    ranked = pairs.withColumn("score", F.floor(score / F.col("den"))).withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy("block", "left_name").orderBy(F.desc("score"), "right_name")
        ),
    )
    return ranked.filter("rank <= 5").select("block", "left_name", "right_name", "num", "den", "rank")


_TOPK_SQL = f"""
  WITH n AS (SELECT DISTINCT sport_id AS block, {normalized_sql("name")} AS name FROM ({PARTICIPANT_SOURCES_SQL}) s),
    scored AS ({similarity_sql("SELECT l.block, l.name AS a, r.name AS b FROM n l JOIN n r ON l.block = r.block AND l.name <> r.name")})
  SELECT block, left_name, right_name, num, den, rank FROM (
    SELECT block, a AS left_name, b AS right_name, num, den,
      row_number() OVER (PARTITION BY block, a ORDER BY floor(num * 1000000 / den) DESC, b) AS rank
    FROM scored WHERE num * 8 >= den * 5) WHERE rank <= 5
"""

_VERDICT_COLUMNS = ["source_id", "state", "reason_code", "canonical_id", "best_units", "candidate_count",
                    "plausible_candidate_count", "hard_rejection_count"]


def _participant_matches(spark: SparkSession, folder: str) -> DataFrame:
    return match_names(
        views.participant_sources(spark, folder), views.participant_entities(spark, folder), None, PARTICIPANT
    )


def participant_match(spark: SparkSession, folder: str) -> DataFrame:
    return _participant_matches(spark, folder).select(*_VERDICT_COLUMNS)


def _ladder_sql(scored: str, counts: str, floor: tuple[int, int], limits: tuple[str, str, str, str]) -> str:
    """``scored``: source_id, id, num, den, score (units) of eligible candidates; ``counts``: per source."""
    auto, gate, margin, plausible = limits
    return f"""
      SELECT source_id, state, CASE state WHEN 'matched' THEN 'auto_match' WHEN 'created' THEN 'no_plausible_candidate'
          ELSE CASE WHEN best - coalesce(runner, 0) < {margin} THEN 'insufficient_margin' ELSE 'plausible_candidate_below_auto_threshold' END
          END AS reason_code, CASE WHEN state = 'matched' THEN id END AS canonical_id, CAST(best AS BIGINT) AS best_units,
        candidate_count, plausible_candidate_count, hard_rejection_count
      FROM (SELECT *, CASE WHEN best >= {auto} AND name_ok AND best - coalesce(runner, 0) >= {margin} THEN 'matched'
            WHEN best >= {plausible} THEN 'ambiguous' ELSE 'created' END AS state
        FROM ({counts}) c LEFT JOIN (
          SELECT source_id AS sid, id, score AS best, num * {gate.split('/')[1]} >= den * {gate.split('/')[0]} AS name_ok, runner FROM (
            SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS runner FROM ({scored}) s WHERE num * {floor[1]} >= den * {floor[0]}
            WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, id)) WHERE rn = 1) b ON b.sid = c.source_id)
    """


def _units_sql(numerator: str, denominator: str) -> str:
    return f"(CAST({numerator} AS HUGEINT) * 1000000000000000000::HUGEINT) // CAST({denominator} AS HUGEINT)"


_PARTICIPANT_SCORED_SQL = f"""
  SELECT source_id, id, num, den,
    {_units_sql("800 * num + (CASE WHEN participant_type = 'team' THEN 150 ELSE 75 END + 25) * den", "1000 * den")} AS score
  FROM ({similarity_sql(f'''SELECT s.source_id, s.participant_type, c.id, {normalized_sql("s.name")} AS a, {normalized_sql("c.name")} AS b
    FROM ({PARTICIPANT_SOURCES_SQL}) s JOIN ({PARTICIPANT_ENTITIES_SQL}) c ON s.sport_id = c.sport_id''')})
"""
_PARTICIPANT_COUNTS_SQL = f"""
  SELECT s.source_id, coalesce(e.candidate_count, 0) AS candidate_count, coalesce(p.n, 0) AS plausible_candidate_count,
    0 AS hard_rejection_count FROM ({PARTICIPANT_SOURCES_SQL}) s
  LEFT JOIN (SELECT sport_id, count(*) AS candidate_count FROM ({PARTICIPANT_ENTITIES_SQL}) c GROUP BY 1) e ON e.sport_id = s.sport_id
  LEFT JOIN (SELECT source_id, count(*) AS n FROM ({_PARTICIPANT_SCORED_SQL}) x WHERE score >= 780000000000000000 GROUP BY 1) p
    ON p.source_id = s.source_id
"""
_PARTICIPANT_SQL = _ladder_sql(
    _PARTICIPANT_SCORED_SQL, _PARTICIPANT_COUNTS_SQL, (5, 8),
    ("920000000000000000", "94/100", "80000000000000000", "780000000000000000"),
)

_COUNTRY = "CASE p_size % 3 WHEN 0 THEN 'IT' WHEN 1 THEN 'FR' END"
_LEAGUE = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, '-league') ELSE concat('The ', p_name) END"


def _competitions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    part = views.table(spark, folder, "part")
    sources = part.select(
        F.col("p_partkey").cast("string").alias("source_id"),
        F.col("p_type").alias("sport_id"),
        F.expr(_LEAGUE).alias("name"),
        F.expr(_COUNTRY).alias("country_code"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN '2026/27' END").alias("season"),
        F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'Women' WHEN p_partkey % 5 < 3 THEN 'Men' END").alias("gender"),
    )
    entities = part.groupBy("p_type", "p_name", F.expr(_COUNTRY).alias("country_code")).agg(
        F.lpad(F.min("p_partkey").cast("string"), 12, "0").alias("id")
    ).select(
        "id", F.col("p_type").alias("sport_id"), F.col("p_name").alias("name"), "country_code",
        F.lit("2026-2027").alias("season"), F.lit("men").alias("gender"),
    )
    return sources, entities


def competition_match(spark: SparkSession, folder: str) -> DataFrame:
    sources, entities = _competitions(spark, folder)
    return match_names(sources, entities, None, COMPETITION).select(*_VERDICT_COLUMNS)


_COMPETITION_PAIRS_SQL = f"""
  SELECT s.source_id, c.id, {normalized_sql("s.name")} AS a, {normalized_sql("c.name")} AS b, s.country AS sc, c.country AS cc,
    s.season AS ss, s.gender AS sg
  FROM (SELECT CAST(p_partkey AS VARCHAR) AS source_id, p_type AS sport_id, {_LEAGUE} AS name, {_COUNTRY} AS country,
      CASE WHEN p_partkey % 2 = 0 THEN '2026-2027' END AS season,
      CASE WHEN p_partkey % 5 = 0 THEN 'women' WHEN p_partkey % 5 < 3 THEN 'men' END AS gender FROM part) s
  JOIN (SELECT lpad(CAST(min(p_partkey) AS VARCHAR), 12, '0') AS id, p_type AS sport_id, p_name AS name, {_COUNTRY} AS country
    FROM part GROUP BY p_type, p_name, {_COUNTRY}) c ON s.sport_id = c.sport_id
"""
_COMPETITION_CLASH = "(coalesce(sc <> cc, false) OR coalesce(sg <> 'men', false))"
_COMPETITION_SCORED_SQL = f"""
  SELECT source_id, id, num, den, {_units_sql('''700 * num + (CASE WHEN sc IS NULL OR cc IS NULL THEN 75 ELSE 150 END
    + CASE WHEN ss IS NULL THEN 50 ELSE 100 END + CASE WHEN sg IS NULL THEN 25 ELSE 50 END) * den''', "1000 * den")} AS score
  FROM ({similarity_sql(_COMPETITION_PAIRS_SQL)}) WHERE NOT {_COMPETITION_CLASH}
"""
_COMPETITION_COUNTS_SQL = f"""
  SELECT a.source_id, candidate_count, coalesce(p.n, 0) AS plausible_candidate_count, hard_rejection_count FROM (
    SELECT source_id, count(*) FILTER (NOT {_COMPETITION_CLASH}) AS candidate_count,
      count(*) FILTER ({_COMPETITION_CLASH}) AS hard_rejection_count FROM ({_COMPETITION_PAIRS_SQL}) GROUP BY 1) a
  LEFT JOIN (SELECT source_id, count(*) AS n FROM ({_COMPETITION_SCORED_SQL}) WHERE score >= 750000000000000000 GROUP BY 1) p
    ON p.source_id = a.source_id
"""
_COMPETITION_SQL = _ladder_sql(
    _COMPETITION_SCORED_SQL, _COMPETITION_COUNTS_SQL, (37, 70),
    ("920000000000000000", "90/100", "80000000000000000", "750000000000000000"),
)


_THEIR_SEASON = "CASE p_size % 4 WHEN 0 THEN '2025-2026' WHEN 1 THEN '2026-2027' WHEN 2 THEN '2026/27' END"
_GENDER = "CASE p_size % 5 WHEN 0 THEN 'Women' WHEN 1 THEN 'men' WHEN 2 THEN ' MEN ' END"


def rejection_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why candidates can't be the competition that a source lists: counts of the first clash in country, season, gender."""
    sources, _ = _competitions(spark, folder)
    part = views.table(spark, folder, "part")
    entities = part.select(
        F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("id"), F.col("p_type").alias("sport_id"), F.col("p_name").alias("name"),
        F.expr(_COUNTRY).alias("country_code"), F.expr(_THEIR_SEASON).alias("season"), F.expr(_GENDER).alias("gender"),
    )
    classes = cut_lineage(prepared_sources(sources, COMPETITION))
    profiles = candidate_profiles(prepared_candidates(entities, None, COMPETITION), COMPETITION)
    counts = eligibility_counts(source_classes(classes, COMPETITION), profiles, COMPETITION)
    reason = lambda name: F.coalesce(F.element_at("hard_rejection_reasons", F.lit(name)), F.lit(0)).cast("bigint").alias(name)
    return classes.join(counts, classes["source_fingerprint"] == counts["class_id"]).select(
        "source_id", "candidate_count", "hard_rejection_count", *[reason(name) for _, name in COMPETITION.conflicts]
    )


_REJECTION_SQL = f"""
  WITH parts AS (SELECT *, CAST(p_partkey AS VARCHAR) AS source_id, {_COUNTRY} AS country,
    CASE WHEN p_partkey % 2 = 0 THEN '2026-2027' END AS season, CASE WHEN p_partkey % 5 = 0 THEN 'women' WHEN p_partkey % 5 < 3 THEN 'men' END AS gender,
    CASE p_size % 4 WHEN 0 THEN '2025-2026' WHEN 3 THEN NULL ELSE '2026-2027' END AS their_season,
    CASE p_size % 5 WHEN 0 THEN 'women' WHEN 1 THEN 'men' WHEN 2 THEN 'men' END AS their_gender FROM part),
  judged AS (SELECT s.source_id, CASE WHEN s.country <> c.country THEN 'country' WHEN s.season <> c.their_season THEN 'season'
      WHEN s.gender <> c.their_gender THEN 'gender' END AS clash FROM parts s JOIN parts c ON s.p_type = c.p_type)
  SELECT source_id, count(*) FILTER (clash IS NULL) AS candidate_count, count(clash) AS hard_rejection_count,
    count(*) FILTER (clash = 'country') AS country_conflict, count(*) FILTER (clash = 'season') AS season_conflict,
    count(*) FILTER (clash = 'gender') AS gender_conflict FROM judged GROUP BY 1
"""


def _event_columns(k: str, start: str) -> str:
    """events as scheduled events; ``k`` varies competition, name, roles and positions."""
    return f"""
  event_type AS sport_id, CASE WHEN event_type = 'view' THEN 'tennis' ELSE event_type END AS sport_code,
  CASE WHEN ({k}) % 9 < 2 THEN NULL WHEN ({k}) % 9 = 2 THEN 'cup' ELSE 'league' END AS competition_id,
  CASE ({k}) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'alpha - beta' WHEN 2 THEN 'alpha beta fc' ELSE 'Alpha Beta' END AS name,
  concat('u', user_id) AS p1, concat('v', user_id % 7) AS p2,
  CASE WHEN ({k}) % 5 = 0 THEN 0 WHEN ({k}) % 11 = 0 THEN 2 ELSE 1 END AS roles,
  CASE WHEN ({k}) % 3 = 0 THEN 0 WHEN ({k}) % 13 = 0 THEN 2 ELSE 1 END AS positions, {start} AS start_time, event_id
"""


# The whole table is the canonical schedule, and the whole table again is what another book lists:
# seven minutes later, with other spellings, roles and gaps.
_CANONICAL_COLUMNS = _event_columns("event_id", "ts")
_LISTED_COLUMNS = _event_columns("event_id + 1", "ts + INTERVAL 7 MINUTE")


def _scheduled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    views.spread(views.table(spark, folder, "events")).createOrReplaceTempView("fairline_events")

    def person(place: int) -> Column:
        return F.struct(
            F.col(f"p{place}").alias("source_id"),
            F.col(f"p{place}").alias("canonical_id"),
            F.when(F.col("roles") != 0, F.when((F.col("roles") == 1) == F.lit(place == 1), "home").otherwise("away")).alias("role"),
            F.when(F.col("positions") != 0, F.when(F.col("positions") == 1, place).otherwise(3 - place)).alias("position"),
        )

    def shaped(columns: str) -> DataFrame:
        return spark.sql(f"SELECT {columns} FROM fairline_events").select(
            "event_id", "sport_id", "sport_code", "competition_id", "name", "start_time",
            F.array(person(1), person(2)).alias("participants"),
        )

    sources = shaped(_LISTED_COLUMNS).select(
        F.col("event_id").cast("string").alias("source_id"), "*", F.col("competition_id").alias("competition_source_id"),
        F.lit("scheduled").alias("status"), F.lit(False).alias("is_live"),
    )
    return sources, shaped(_CANONICAL_COLUMNS).withColumn("id", F.lpad(F.col("event_id").cast("string"), 12, "0"))


_EVENT_COUNTS = ["candidate_count", "plausible_candidate_count", "competition_conflicts", "shape_conflicts", "role_risks",
                 "position_risks", "time_risks"]


def event_match(spark: SparkSession, folder: str) -> DataFrame:
    sources, entities = _scheduled(spark, folder)
    return event_matching.match_events(sources, entities).select(
        "source_id", "state", "reason_code", "canonical_id", "best_units", *_EVENT_COUNTS
    )


def event_duplicate_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Risk histogram per sport over all source events."""
    sources, entities = _scheduled(spark, folder)
    return event_matching.match_events(sources, entities).groupBy("sport_id").agg(
        *[F.sum(c).alias(c) for c in ("role_risks", "position_risks", "time_risks")], F.count_if(F.col("risks") != 0).alias("at_risk")
    )


_EVENT_PAIRS_SQL = f"""
  SELECT *, CASE WHEN conflict THEN 0 WHEN sr <> 0 AND cr <> 0 THEN CASE WHEN sr <> cr THEN 1 WHEN delta > auto THEN 4 ELSE 0 END
      WHEN sp <> 0 AND cp <> 0 AND sp <> cp THEN 2 WHEN delta > auto THEN 4 ELSE 0 END AS risk,
    (sr <> 0 AND cr <> 0) OR (sp <> 0 AND cp <> 0) AS placed
  FROM (SELECT s.event_id AS source_id, lpad(CAST(c.event_id AS VARCHAR), 12, '0') AS id, s.roles AS sr, c.roles AS cr,
      s.positions AS sp, c.positions AS cp, {normalized_sql("s.name")} AS a, {normalized_sql("c.name")} AS b,
      coalesce(s.competition_id <> c.competition_id, false) AS conflict,
      s.competition_id IS NOT NULL AND c.competition_id IS NOT NULL AS both_known,
      abs(epoch_us(s.start_time) - epoch_us(c.start_time)) AS delta,
      CASE WHEN s.sport_code = 'tennis' THEN 21600000000 ELSE 1800000000 END AS auto,
      CASE WHEN s.sport_code = 'tennis' THEN 172800000000 ELSE 86400000000 END AS guard
    FROM (SELECT {_LISTED_COLUMNS} FROM events) s JOIN (SELECT {_CANONICAL_COLUMNS} FROM events) c
      ON s.sport_id = c.sport_id AND s.p1 = c.p1)
  WHERE delta <= guard
"""
_EVENT_SCORED_SQL = f"""
  SELECT *, CASE WHEN NOT conflict AND risk = 0 THEN {_units_sql('''(750 + CASE WHEN placed THEN 100 ELSE 50 END
    + CASE WHEN both_known THEN 100 ELSE 50 END) * auto * q - 125 * delta * q + 50 * p * auto''', "1000 * auto * q")} END AS score
  FROM (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 1 ELSE num END AS p, CASE WHEN a IS NULL OR b IS NULL THEN 2 ELSE den END AS q
    FROM ({similarity_sql(_EVENT_PAIRS_SQL)}))
"""
_EVENT_AGG_SQL = f"""
  SELECT source_id, count(score) AS candidate_count, count(*) FILTER (score >= 780000000000000000) AS plausible_candidate_count,
    count(*) FILTER (conflict) AS competition_conflicts, count(*) FILTER (risk = 1) AS role_risks,
    count(*) FILTER (risk = 2) AS position_risks, count(*) FILTER (risk = 4) AS time_risks, count(*) AS same_set
  FROM ({_EVENT_SCORED_SQL}) GROUP BY 1
"""
_EVENT_SQL = f"""
  WITH scored AS ({_EVENT_SCORED_SQL}), agg AS ({_EVENT_AGG_SQL}),
    best AS (SELECT source_id, id, score AS best, runner FROM (
      SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS runner FROM scored WHERE score IS NOT NULL
      WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, id)) WHERE rn = 1),
    windowed AS (SELECT s.event_id AS source_id, count(*) AS in_window FROM events s JOIN events c
      ON s.event_type = c.event_type AND abs(epoch_us(s.ts + INTERVAL 7 MINUTE) - epoch_us(c.ts)) <= CASE WHEN s.event_type = 'view' THEN 172800000000 ELSE 86400000000 END GROUP BY 1)
  SELECT CAST(e.event_id AS VARCHAR) AS source_id, state,
    CASE WHEN state = 'matched' THEN 'auto_match' WHEN state = 'created' THEN 'no_plausible_candidate'
      WHEN best >= 780000000000000000 THEN CASE WHEN best - coalesce(runner, 0) < 50000000000000000 THEN 'insufficient_margin'
        ELSE 'plausible_candidate_below_auto_threshold' END
      WHEN role_risks > 0 THEN 'duplicate_risk_role_conflict' WHEN position_risks > 0 THEN 'duplicate_risk_position_conflict'
      ELSE 'duplicate_risk_time_window' END AS reason_code,
    CASE WHEN state = 'matched' THEN id END AS canonical_id, CAST(best AS BIGINT) AS best_units,
    candidate_count, plausible_candidate_count, competition_conflicts, in_window - same_set AS shape_conflicts, role_risks, position_risks, time_risks
  FROM (SELECT e.event_id, b.*, coalesce(a.candidate_count, 0) AS candidate_count, coalesce(a.plausible_candidate_count, 0) AS plausible_candidate_count,
      coalesce(competition_conflicts, 0) AS competition_conflicts, coalesce(role_risks, 0) AS role_risks,
      coalesce(position_risks, 0) AS position_risks, coalesce(time_risks, 0) AS time_risks, coalesce(same_set, 0) AS same_set,
      coalesce(in_window, 0) AS in_window,
      CASE WHEN best >= 900000000000000000 AND best - coalesce(runner, 0) >= 50000000000000000 THEN 'matched'
        WHEN best >= 780000000000000000 OR coalesce(role_risks + position_risks + time_risks, 0) > 0 THEN 'ambiguous' ELSE 'created' END AS state
    FROM events e LEFT JOIN best b ON b.source_id = e.event_id LEFT JOIN agg a ON a.source_id = e.event_id
      LEFT JOIN windowed w ON w.source_id = e.event_id) e
"""
_RISK_SQL = f"""
  SELECT e.event_type AS sport_id, CAST(sum(coalesce(role_risks, 0)) AS BIGINT) AS role_risks, CAST(sum(coalesce(position_risks, 0)) AS BIGINT) AS position_risks,
    CAST(sum(coalesce(time_risks, 0)) AS BIGINT) AS time_risks, count(*) FILTER (coalesce(role_risks + position_risks + time_risks, 0) > 0) AS at_risk
  FROM events e LEFT JOIN ({_EVENT_AGG_SQL}) a ON a.source_id = e.event_id GROUP BY 1
"""


def mapping_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Per book: quotes whose supplier has a mapping and those that must be resolved."""
    mappings = views.table(spark, folder, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").cast("string").alias("source_id"), F.col("s_name").alias("canonical_id")
    )
    seen = views.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("source_id")).agg(
        F.count("*").alias("n_quotes")
    )
    return seen.join(mappings, "source_id", "left").select(
        "source_id", "n_quotes", "canonical_id",
        F.when(F.col("canonical_id").isNotNull(), "reused").otherwise("to_resolve").alias("state"),
    )


def mapping_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Known suppliers touched, new ones inserted from a month of quotes."""
    start = F.lit("1990-01-01").cast("timestamp")
    known = merge.mapping_rows(
        views.table(spark, folder, "supplier").filter("s_acctbal > 0").select(
            F.lit("book-0").alias("bookmaker_id"), F.lit("participant").alias("entity_type"),
            F.col("s_suppkey").cast("string").alias("source_id"), F.concat(F.lit("c"), "s_suppkey").alias("canonical_id"),
            F.col("s_name").alias("source_name"),
        ),
        start,
    )
    seen = views.table(spark, folder, "lineitem").select(
        F.lit("book-0").alias("bookmaker_id"), F.lit("participant").alias("entity_type"),
        F.col("l_suppkey").cast("string").alias("source_id"), F.concat(F.lit("c"), "l_suppkey").alias("canonical_id"),
        F.concat(F.lit("seen-"), "l_suppkey").alias("source_name"), F.col("l_shipdate").cast("timestamp").alias("at"),
    )
    merged, _ = merge.upsert_mappings(known, merge.mapping_rows(seen, F.col("at")))
    return merged.select(
        "source_id", "canonical_id", "source_name",
        F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"),
        F.col("last_seen_at").cast("timestamp_ntz").alias("last_seen_at"),
    )


def manual_remap(spark: SparkSession, folder: str) -> DataFrame:
    """Mappings after a reviewer moved every supplier with a negative balance to its nation's entity."""
    at = F.lit("1990-01-01").cast("timestamp")
    known = views.table(spark, folder, "supplier").select(
        F.lit("book-0").alias("bookmaker_id"), F.lit("participant").alias("entity_type"),
        F.col("s_suppkey").cast("string").alias("source_id"), F.concat(F.lit("c"), "s_suppkey").alias("canonical_id"),
        F.col("s_name").alias("source_name"), F.col("s_acctbal"), F.col("s_nationkey"),
    )
    orders = known.filter("s_acctbal < 0").select(
        "bookmaker_id", "entity_type", "source_id", F.concat(F.lit("n"), "s_nationkey").alias("canonical_id"), F.lit("review").alias("note")
    )
    moved, decisions = remap(merge.mapping_rows(known, at), orders, F.lit("2026-01-01").cast("timestamp"))
    judged = decisions.select("source_id", "state", "reason_code", "decision_key")
    return moved.join(judged, "source_id", "left").select(
        "source_id", "canonical_id", F.col("last_seen_at").cast("timestamp_ntz").alias("last_seen_at"), "state", "reason_code", "decision_key"
    )


_REMAP_SQL = """
  SELECT CAST(s_suppkey AS VARCHAR) AS source_id, CASE WHEN moved THEN concat('n', s_nationkey) ELSE concat('c', s_suppkey) END AS canonical_id,
    CASE WHEN moved THEN TIMESTAMP '2026-01-01' ELSE TIMESTAMP '1990-01-01' END AS last_seen_at, CASE WHEN moved THEN 'matched' END AS state,
    CASE WHEN moved THEN 'manual_remap' END AS reason_code,
    CASE WHEN moved THEN sha256(concat('book-0|participant|', s_suppkey, '|', sha256(concat('n', s_nationkey, '|review')), '|manual-v1')) END AS decision_key
  FROM (SELECT *, s_acctbal < 0 AS moved FROM supplier)
"""


def alias_learning(spark: SparkSession, folder: str) -> DataFrame:
    """Alias rows learned from every matched source."""
    entities = views.participant_entities(spark, folder)
    accepted = _participant_matches(spark, folder).filter("state = 'matched'").select(
        F.col("canonical_id").alias("id"), F.col("name").alias("source_name"), F.col("bookmaker_id").alias("bookmaker_code")
    ).join(entities.select("id", F.col("name").alias("canonical_name")), "id")
    return merge.learned_aliases(
        spark.createDataFrame([], TABLES["participant_aliases"]), accepted, "participant_id"
    )


def decision_replay(spark: SparkSession, folder: str) -> DataFrame:
    """A second run with an emptied candidate table: mappings and stored decisions still answer."""
    sources = views.participant_sources(spark, folder)
    first = cut_lineage(_participant_matches(spark, folder))
    key = keys.decision_key(F.col("bookmaker_id"), "participant", F.col("source_id"), F.col("source_fingerprint"))
    made = keys.canonical_id(F.col("bookmaker_id"), "participant", F.col("source_id"))
    stored = first.select(
        "bookmaker_id", "source_id", key.alias("decision_key"), "state", "reason_code",
        F.when(F.col("state") == "created", made).otherwise(F.col("canonical_id")).alias("canonical_id"),
    )
    mappings = stored.filter("canonical_id IS NOT NULL").select(
        "bookmaker_id", F.lit("participant").alias("entity_type"), "source_id", "canonical_id"
    )
    again = sources.select(
        "*", F.col("source_id").alias("event_key"), F.col("source_id").cast("bigint").alias("event_seq"),
        F.lit(0).alias("ordinal"), F.lit(True).alias("open"),
    )
    empty = views.participant_entities(spark, folder).filter("id IS NULL")
    result = resolve_names(again, empty, None, mappings, stored, PARTICIPANT)
    return result.outcomes.select("source_id", "state", "reason_code", "canonical_id")


_REPLAY_SQL = f"""
  SELECT p.source_id, CASE WHEN state IN ('matched', 'created') THEN 'reused' ELSE state END AS state,
    CASE WHEN state IN ('matched', 'created') THEN 'mapping_reused' ELSE reason_code END AS reason_code,
    CASE state WHEN 'matched' THEN canonical_id WHEN 'created' THEN
      {uuid5_sql(keys.CANONICAL_NAMESPACE, "bookmaker_id || ':participant:' || s.source_id")} END AS canonical_id
  FROM ({_PARTICIPANT_SQL}) p JOIN ({PARTICIPANT_SOURCES_SQL}) s ON s.source_id = p.source_id
"""


def participant_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """All parts as one ordered batch: created entities and learned names count for later rows."""
    batch = views.participant_sources(spark, folder).select(
        "*", F.col("source_id").alias("event_key"), F.col("source_id").cast("bigint").alias("event_seq"),
        F.lit(0).alias("ordinal"), F.lit(True).alias("open"),
    )
    nothing = spark.createDataFrame([], "id string, sport_id string, name string, participant_type string, country_code string")
    result = resolve_names(
        batch, nothing, None, spark.createDataFrame([], TABLES["source_entity_mappings"]),
        spark.createDataFrame([], TABLES["match_decisions"]), PARTICIPANT,
    )
    return result.outcomes.select("source_id", "state", "reason_code", "canonical_id")


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Open decisions with their best candidates, one row per candidate."""
    decided = _participant_matches(spark, folder)
    decisions = decided.select(F.col("source_id").alias("id"), "state", "reason_code")
    candidates = decided.filter("candidates IS NOT NULL").select(
        F.col("source_id").alias("decision_id"), F.explode("candidates").alias("c")
    ).select("decision_id", "c.candidate_id", "c.rank", "c.score")
    queue = readmodels.review_queue(decisions, candidates)
    return queue.select(F.col("id").alias("source_id"), "state", "reason_code", F.explode("candidates").alias("c")).select(
        "source_id", "state", "reason_code", F.col("c.rank").alias("rank"), F.col("c.candidate_id").alias("candidate_id")
    )


_QUEUE_SQL = f"""
  SELECT p.source_id, p.state, p.reason_code, CAST(r.rn AS INTEGER) AS rank, r.id AS candidate_id FROM ({_PARTICIPANT_SQL}) p
  JOIN (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) AS rn
    FROM ({_PARTICIPANT_SCORED_SQL}) WHERE num * 8 >= den * 5) r ON r.source_id = p.source_id AND r.rn <= 5
  WHERE p.state = 'ambiguous'
"""


def resolution_metrics(spark: SparkSession, folder: str) -> DataFrame:
    from fairline.operators.quality import resolution_metrics as summary

    decided = _participant_matches(spark, folder).select(
        F.lit("participant").alias("entity_type"), F.lit("prematch-v1").alias("rule_version"), "state"
    )
    return summary(decided)


QUERIES = {
    "normalize_names": (
        normalize_names,
        f"SELECT doc_id, md5({normalized_sql('text')}) AS norm_digest, length({normalized_sql('text')}) AS norm_length FROM documents",
    ),
    "season_country_tokens": (season_country_tokens, _TOKENS_SQL),
    "canonical_ids": (canonical_ids, _IDS_SQL),
    "decision_keys": (decision_keys, _DECISION_KEYS_SQL),
    "name_similarity_topk": (name_similarity_topk, _TOPK_SQL),
    "participant_match": (participant_match, _PARTICIPANT_SQL),
    "competition_match": (competition_match, _COMPETITION_SQL),
    "rejection_reasons": (rejection_reasons, _REJECTION_SQL),
    "event_match": (event_match, _EVENT_SQL),
    "event_duplicate_risk": (event_duplicate_risk, _RISK_SQL),
    "mapping_lookup": (
        mapping_lookup,
        """SELECT source_id, n_quotes, s_name AS canonical_id, CASE WHEN s_name IS NULL THEN 'to_resolve' ELSE 'reused' END AS state
          FROM (SELECT CAST(l_suppkey AS VARCHAR) AS source_id, count(*) AS n_quotes FROM lineitem GROUP BY 1)
          LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = source_id AND s_acctbal > 0""",
    ),
    "mapping_upsert": (
        mapping_upsert,
        """SELECT coalesce(CAST(s_suppkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS source_id,
            concat('c', coalesce(s_suppkey, l_suppkey)) AS canonical_id,
            CASE WHEN l_suppkey IS NOT NULL THEN concat('seen-', l_suppkey) ELSE s_name END AS source_name,
            CASE WHEN s_suppkey IS NOT NULL THEN TIMESTAMP '1990-01-01' ELSE lo END AS first_seen_at,
            coalesce(hi, TIMESTAMP '1990-01-01') AS last_seen_at
          FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s
          FULL JOIN (SELECT l_suppkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1) l ON l_suppkey = s_suppkey""",
    ),
    "alias_learning": (
        alias_learning,
        f"""SELECT participant_id, normalized_alias, source FROM (
          SELECT participant_id, normalized_alias, arg_min(source, (place, source)) AS source FROM (
            SELECT p.canonical_id AS participant_id, {normalized_sql("c.name")} AS normalized_alias, 'canonical' AS source, 0 AS place
            FROM ({_PARTICIPANT_SQL}) p JOIN ({PARTICIPANT_ENTITIES_SQL}) c ON c.id = p.canonical_id
            UNION ALL SELECT p.canonical_id, {normalized_sql("s.name")}, 'bookmaker:' || s.bookmaker_id, 1
            FROM ({_PARTICIPANT_SQL}) p JOIN ({PARTICIPANT_SOURCES_SQL}) s ON s.source_id = p.source_id WHERE p.state = 'matched')
          GROUP BY 1, 2)""",
    ),
    "manual_remap": (manual_remap, _REMAP_SQL),
    "decision_replay": (decision_replay, _REPLAY_SQL),
    "participant_resolution": (participant_resolution, None),
    "review_queue": (review_queue, _QUEUE_SQL),
    "resolution_metrics": (
        resolution_metrics,
        f"""SELECT 'participant' AS entity_type, 'prematch-v1' AS rule_version, count(*) FILTER (state = 'matched') AS matched,
            count(*) FILTER (state = 'created') AS created, count(*) FILTER (state = 'ambiguous') AS ambiguous,
            count(*) FILTER (state = 'unresolved') AS unresolved, count(*) FILTER (state = 'rejected') AS rejected
          FROM ({_PARTICIPANT_SQL}) p""",
    ),
}
