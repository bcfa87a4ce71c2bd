"""Registered queries of packing, language identification, secret scans and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import table
from fairline.llm.language import held_out, identify, learn
from fairline.llm.packing import pack, word_tokenizer
from fairline.llm.quality import judge_quality, references
from fairline.llm.secret_scan import scan


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(table(spark, folder, "documents").select("doc_id", "text"), word_tokenizer())


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; documents whose id's crc32 leaves 2 modulo 4 are not learned from."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    prototypes = learn(docs.where(~held_out("doc_id")))
    judged = identify(docs, prototypes, carry=["doc_id"]).select("row.doc_id", "lang_pred", "score")
    return judged.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged = judge_quality(docs, references(docs), carry=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base spans, and all spans."""
    found = scan(table(spark, folder, "documents").select("doc_id", "text"), carry=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "added"))
    return found.select("row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))


QUERIES = {
    "op5_secret_scan": (op5_secret_scan, None),
    "op10_quality_rules": (op10_quality_rules, None),
    "op3_packing": (op3_packing, None),
    "op8_language_id": (op8_language_id, None),
}
