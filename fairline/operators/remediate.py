"""Deliberate remapping: a reviewer's decision is appended and the mapping moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions import keys
from fairline.operators.merge import MAPPING_KEY, mapping_rows
from fairline.schemas import TABLES, struct

MANUAL_VERSION = "manual-v1"


def remap(mappings: DataFrame, instructions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(mappings after the move, decision rows to append).

    ``instructions``: bookmaker_id, entity_type, source_id, canonical_id, note. This is the only
    path that changes the entity of a stored mapping; earlier decisions stay as they are.
    """
    wanted = instructions.groupBy(*MAPPING_KEY).agg(
        F.max_by(F.struct("canonical_id", "note"), F.struct("canonical_id", "note")).alias("i")
    )
    moved = mappings.alias("m").join(wanted, MAPPING_KEY, "left").select(
        *[F.coalesce("i.canonical_id", "m.canonical_id").alias(c) if c == "canonical_id"
          else (F.when(F.col("i").isNotNull(), now).otherwise(F.col("m.last_seen_at")).alias(c) if c == "last_seen_at"
                else F.col(c if c in MAPPING_KEY else f"m.{c}"))
          for c in mappings.columns]
    )
    fresh = wanted.join(mappings.select(*MAPPING_KEY), MAPPING_KEY, "left_anti").select(
        *MAPPING_KEY, F.col("i.canonical_id").alias("canonical_id"), F.lit(None).cast("string").alias("source_name")
    )
    fingerprint = F.sha2(F.concat_ws("|", "i.canonical_id", "i.note"), 256)
    key = keys.decision_key(F.col("bookmaker_id"), F.col("entity_type"), F.col("source_id"), fingerprint, MANUAL_VERSION)
    decisions = wanted.select(
        keys.decision_id(key).alias("id"), *MAPPING_KEY, fingerprint.alias("source_fingerprint"),
        F.lit(MANUAL_VERSION).alias("rule_version"), key.alias("decision_key"), F.lit("matched").alias("state"),
        F.col("i.canonical_id").alias("canonical_id"), F.lit("manual_remap").alias("reason_code"),
        F.lit(None).cast("decimal(7,5)").alias("best_score"), F.lit(None).cast("decimal(7,5)").alias("runner_up_score"),
        F.to_json(F.struct(F.col("i.note").alias("note"))).alias("evidence"), now.alias("created_at"),
    )
    return (
        moved.unionByName(mapping_rows(fresh, now)).select(*mappings.columns),
        decisions.select(*struct(TABLES["match_decisions"]).fieldNames()),
    )
