"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One permutation spreads the shingles over the ring of 64-bit values; a second one, read at the shingle's place shifted by
k, gives coordinate k of the signature, so two permutations make all coordinates. Texts with equal shingle sets are one
class. Classes that agree in a band are candidates, and a link is a candidate pair whose full sets reach the similarity.

Only what changes a component is compared, so a bucket is never expanded into all its pairs:

1. In each bucket all classes are compared with its most popular one (the pivot), then with a second pivot among the
   classes that are still apart.
2. What is left apart in a bucket is compared pair by pair where the sizes and the number of shingles that each text
   shares with any other allow the similarity at all, once for all the bands that a pair has in common. The bounds are exact,
   so no link is lost.

Bands are chosen so that a pair at the similarity itself shares none with a probability of at most ``miss``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import keys, mapped, stage, whole
from fairline.llm.graph import extended
from fairline.llm.words import U, mix, parts, shingle_sets

ROWS_PER_BAND = 4
RARE = 16  # texts that share a shingle which is joined on
_BLOCK = 1 << 15  # shingles worked on at once
_CLASS = "struct<x:long,y:long>"


def bands_for(similarity: float, miss: float = 1e-6, rows: int = ROWS_PER_BAND) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates for each of the non-empty sets."""
    out = np.empty((len(sets), size), U)
    begin = 0
    while begin < len(sets):
        end, total = begin + 1, len(sets[begin])
        while end < len(sets) and total + len(sets[end]) <= _BLOCK:
            total += len(sets[end])
            end += 1
        starts = np.cumsum([0, *map(len, sets[begin : end - 1])])
        ring = mix(np.concatenate(sets[begin:end]) + U(0x9E3779B97F4A7C15))
        for k in range(size):
            v = ring - U(k)
            v ^= v >> U(32)
            v *= U(0xD6E8FEB86659FD93)
            v ^= v >> U(32)
            v *= U(0xA0761D6478BD642F)
            v ^= v >> U(29)
            out[begin:end, k] = np.minimum.reduceat(v, starts)
        begin = end
    return out


def _signer(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = list(shingle_sets(batch.column("text"), k))
            sizes = np.array([len(s) for s in sets], np.int64)
            held = [s for s in sets if len(s)]
            digest = np.zeros((2, len(sets)), U)
            if held:
                digest[0, sizes > 0] = [mix(s).sum(dtype=U) for s in held]
                digest[1, sizes > 0] = [np.bitwise_xor.reduce(mix(s ^ U(0xA5A5A5A5))) for s in held]
            code = np.zeros((len(sets), bands), U)
            if held:
                sign = signatures(held, bands * rows)
                for b in range(bands):
                    h = np.full(len(held), b + 1, U)
                    for r in range(rows):
                        h = mix(h * U(0x9E3779B97F4A7C15) + sign[:, b * rows + r])
                    code[sizes > 0, b] = h
            lists = pa.ListArray.from_arrays(np.arange(0, code.size + 1, bands, dtype=np.int32), pa.array(code.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("k1"), batch.column("k2"), pa.array(sizes), pa.StructArray.from_arrays([pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64))], ["x", "y"]), lists],
                ["id", "k1", "k2", "n", "c", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            held = [s.tobytes() for s in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(held, pa.binary())], ["c", "shingles"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full shingle sets reach the similarity."""
    left = sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return stage(mapped(joined, _verified(percent), f"a {_CLASS}, b {_CLASS}"), "links")


def _apart(places: DataFrame, labels: DataFrame) -> DataFrame:
    """Places (``bucket``, ``c``, ...) with their component's label, of the buckets that still hold two components."""
    named = places.join(labels, F.col("c") == F.col("node"), "left").select(*places.columns, F.coalesce("label", "c").alias("label"))
    open_ = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    # Tables that rows are joined back to by the key they were grouped by are written first: the join then has exchanges of its
    # own and can split the rows of a hot bucket over tasks.
    open_ = stage(open_, "open")
    return stage(named.join(open_, "bucket"), "apart")


def _with_pivot(apart: DataFrame) -> DataFrame:
    """Pairs of each class with the most popular class of its bucket."""
    pivots = stage(apart.groupBy("bucket").agg(F.max(F.struct("popular", "c", "label")).alias("p")), "pivots")
    pairs = apart.join(pivots, "bucket").where("label <> p.label")
    return pairs.select(F.col("c").alias("a"), F.col("p.c").alias("b")).distinct()


def _with_second_pivot(apart: DataFrame) -> DataFrame:
    """Pairs of each class with the most popular class outside the component of its bucket's first pivot."""
    apart = apart.where("size > 2")
    top = stage(apart.groupBy("bucket").agg(F.max(F.struct("popular", "c", "label")).alias("top")), "top")
    rest = apart.join(top, "bucket")
    pivots = stage(rest.where("label <> top.label").groupBy("bucket").agg(F.max(F.struct("popular", "c", "label")).alias("p")), "pivots")
    pairs = rest.join(pivots, "bucket").where("label <> p.label and c <> top.c")
    return pairs.select(F.col("c").alias("a"), F.col("p.c").alias("b")).distinct()


def _possible_pairs(apart: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of different components, from buckets of more than three, whose sets can reach the similarity at all.

    A shingle is shared if it is in two or more of the open texts, rare if in at most RARE and common if in more. ``u``
    counts a text's shared shingles, ``common`` its common ones. A pair has at most m shingles in both, where m is

    * r + the smaller ``common``, for pairs with r > 0 rare shingles in both; joining on rare shingles finds and counts them,
    * the smaller ``common`` for all other pairs in a bucket.

    Sizes p <= q reach the similarity only if 100 m >= percent (p + q - m). For the second kind that is q <= high(p) and
    p <= high(q) with high(s) = (100 + percent) common / percent - s, compared by joining on bins of sizes whose bounds are the
    similarity apart, so that p is in the bin of q or the one below. A pair is only taken from the bucket of its first common
    band: where that bucket isn't looked at here, the pair is in one component or the pivots have met both.
    """
    apart = apart.where("size > 3")  # in smaller buckets the pivots have met every class
    held = apart.select("c", "label").distinct().join(sets, "c")
    each = held.select("c", "label", (F.length("shingles") / 8).cast("long").alias("n"), F.explode(F.expr("transform(sequence(0, int(length(shingles) / 8) - 1), i -> substring(shingles, i * 8 + 1, 8))")).alias("s"))
    each = stage(each, "shingles")
    shared = stage(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    marked = stage(each.join(shared, "s"), "shared")
    counted = marked.groupBy("c").agg(F.first("n").alias("n"), F.count("*").alias("u"), F.count_if(F.col("df") > RARE).alias("common"))
    counted = stage(counted.where(f"100 * u >= {percent} * n").join(classes.select("c", "bands"), "c"), "counted")

    rare = marked.where(f"df <= {RARE}").select("s", "c", "label").join(counted, "c")
    left = rare.select("s", F.col("c").alias("a"), F.col("label").alias("la"), F.col("n").alias("p"), F.col("u").alias("ua"), F.col("common").alias("ca"))
    right = rare.select("s", F.col("c").alias("b"), F.col("label").alias("lb"), F.col("n").alias("q"), F.col("u").alias("ub"), F.col("common").alias("cb"))
    enough = lambda m: F.expr(f"100 * ({m}) >= {percent} * (p + q - ({m}))")
    both = left.join(right, "s").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & enough("least(ua, ub)"))
    both = both.groupBy("a", "b").agg(F.count("*").alias("r"), *[F.first(x).alias(x) for x in ("p", "q", "ca", "cb")])
    first = both.where(enough("r + least(ca, cb)")).select("a", "b")

    bin_ = lambda x: F.floor(F.log(x.cast("double")) / F.log(F.lit(100 / percent)))
    high = F.floor((100 + percent) * F.col("common") / percent) - F.col("n")
    places = apart.join(counted.withColumn("high", high), "c")
    small = places.where("high >= n").select("bucket", F.col("c").alias("a"), F.col("label").alias("la"), F.col("n").alias("p"), F.col("high").alias("ha"), F.col("bands").alias("xa"), bin_(F.col("n")).alias("bin"))
    low = F.ceil(F.col("n") * percent / 100)
    top = F.least("n", "high")
    large = places.where(top >= low).join(small.select("bucket").distinct(), "bucket", "left_semi").select("bucket", F.col("c").alias("b"), F.col("label").alias("lb"), F.col("n").alias("q"), F.col("high").alias("hb"), F.col("bands").alias("xb"), F.explode(F.sequence(bin_(low), bin_(top))).alias("bin"))
    on = (F.col("la") != F.col("lb")) & F.expr(f"p <= q and 100 * p >= {percent} * q and q <= ha and p <= hb and (p < q or a < b)")
    on = on & F.expr("element_at(filter(zip_with(xa, xb, (x, y) -> if(x = y, x, null)), x -> x is not null), 1) = bucket")
    return first.union(small.join(large, ["bucket", "bin"]).where(on).select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, rows: int = ROWS_PER_BAND, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` (all columns, or those in ``carry``) with ``n_shingles``, ``component_id`` and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z. A text with fewer words than a shingle is one shingle. A null text
    or one without words has none and links with nothing; its component is itself. Rows that repeat in id and text share
    one result. A null id never names a component unless all of its members have null ids; such rows are kept. Other
    columns are only carried. Empty tables give empty results.
    """
    bands = bands_for(percent / 100, rows=rows)
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).select("id", "text", *keys("id", "text"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    signed = stage(mapped(slim, _signer(words, bands, rows), f"id {id_type}, k1 long, k2 long, n long, c {_CLASS}, bands array<long>"), "signed")
    classes = signed.where("n > 0").groupBy("c").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.min(F.struct("k1", "k2")).alias("k"))
    classes = stage(classes, "classes")

    places = classes.select("c", F.explode("bands").alias("bucket"))
    shared = stage(places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    places = stage(places.join(shared, "bucket"), "places")
    popular = places.groupBy("c").agg(F.sum("size").alias("popular"))
    places = places.join(popular, "c")

    wanted = popular.join(classes, "c").select("c", "k.k1", "k.k2")
    texts = slim.join(wanted, ["k1", "k2"]).select("c", "text")
    sets = stage(mapped(texts, _sets(words), f"c {_CLASS}, shingles binary").dropDuplicates(["c"]), "sets")

    labels = places.select(F.col("c").alias("node"), F.col("c").alias("label")).limit(0)
    for pairs_of in (_with_pivot, _with_second_pivot, lambda apart: _possible_pairs(apart, classes, sets, percent)):
        apart = _apart(places, labels)
        if apart.isEmpty():
            break
        labels = extended(labels, _links(pairs_of(apart), sets, percent))

    named = classes.join(labels, F.col("c") == F.col("node"), "left").select("c", "id", F.coalesce("label", "c").alias("label"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    answers = named.join(smallest, "label").select("c", "component_id")
    by_row = signed.select("k1", "k2", "n", "c").distinct().join(answers, "c", "left").select("k1", "k2", F.col("n").alias("n_shingles"), "component_id")
    rows_ = docs.select(whole(docs if carry is None else docs.select(*carry)), F.col(doc_id).alias("id"), F.col(text).alias("text")).select("row", "id", *keys("id", "text"))
    out = rows_.join(by_row, ["k1", "k2"])
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("row", "id", "n_shingles", component.alias("component_id")).select("row", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
