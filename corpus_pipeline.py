"""The corpus pipeline: language identification, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result to the shared folder and hands what it reads back to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import put, stage, table
from fairline.llm.decontaminate import remove_contaminated
from fairline.llm.language import identify, learn, score_limits, size_class
from fairline.llm.line_dedup import remove_repeated_runs
from fairline.llm.minhash import near_duplicates
from fairline.llm.packing import pack, word_tokenizer

MIN_SCORE = 0.01  # cosine with the best prototype; what is below resembles no language, whatever the limits learned from the labels
LONG_LINE = 50  # words; a line of so many counts as a run by itself


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, or like none of the languages learned from ``lang``, go.

    Like a language means a score that labelled documents of the same size have; see ``score_limits``.
    """
    judged = stage(identify(docs, learn(docs)), "judged")
    limits = F.create_map(*[F.lit(x) for pair in score_limits(judged, MIN_SCORE).items() for x in pair])
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= F.element_at(limits, size_class()))).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two lines or more, and of single long lines, go from the texts; a document with no word left goes."""
    out = remove_repeated_runs(docs, window=2, long_words=LONG_LINE)
    left = out.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    chars = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text"))
    return put(left, "row", docs.columns, text=F.col("kept_text"), n_chars=chars.cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_duplicates(docs, words=5, percent=80).where("kept").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences of 4096 tokens."""
    return pack(docs, word_tokenizer())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]
ORACLE_SQL = None  # language profiles and tokens are beyond SQL; tests/llm compares the run with its own stages, and some stages with plain models


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
