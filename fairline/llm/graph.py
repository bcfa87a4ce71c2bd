"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``) for every end of the edges (``a``, ``b``); label is the smallest node reachable.

    Each round takes the smallest label around a node, then the label of that label (pointer jumping). Rounds are
    written to the shared folder. An empty edge table gives an empty result; loops and repeated edges are harmless.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        lower = lower.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))
        lower = stage(lower, "labels")
        labels = lower.select("node", "label")
        if lower.where("label <> old").isEmpty():
            return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` of a graph after ``links`` (``a``, ``b``) are added to it; only the components they join are worked on."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    named = named.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    joined = components(named).select(F.col("node").alias("label"), F.col("label").alias("lower"))
    known = labels.join(joined, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    new = joined.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("lower").alias("label"))
    return stage(known.union(new), "labels")
