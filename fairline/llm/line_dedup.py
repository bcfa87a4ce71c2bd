"""Line dedup by winnowing over line hashes.

1. Every document becomes the sequence of its lines' hashes (lines without a word are passed over). In each window of
   ``window`` lines the smallest hash is selected: any repeated run of at least so many lines has a selected line at the
   same place in each of its copies, so no run can be missed.
2. Selected lines are joined by hash. One that is found at a single place is dropped here, which is most of the corpus.
3. Around a selected line that repeats, the match is extended both ways, window by window: the lines of a window count as
   a match when all of them equal those of an earlier window. The overlapping windows of a run join up to the whole run,
   whatever its length and whichever documents its parts were copied from.
   With ``long_words``, a line of so many words is a window of its own, by the same joins.
4. Lines of later copies are deleted; the first copy stays.

Windows are compared with the first occurrence of their content only, so a line or passage held by a third of all rows
costs one row for each occurrence, never pairs of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import keys, stage, whole


def _windows(docs: DataFrame, window: int, long_words: int | None) -> DataFrame:
    """A row for each window: the document's keys and order, the selected line (``mark``) and its place, two hashes of
    the lines, and the lines' numbers."""
    # Possessive and anchored, so a line is read once.
    long = "" if long_words is None else f", 'long', l rlike '^[\\\\x20\\\\x09-\\\\x0D]*+(?:[^\\\\x20\\\\x09-\\\\x0D]++[\\\\x20\\\\x09-\\\\x0D]*+){{{long_words}}}'"
    numbered = f"transform(split(text, '\\n', -1), (l, i) -> named_struct('i', i, 'full', l rlike '[^\\\\x20\\\\x09-\\\\x0D]', 'h', xxhash64(l), 'g', xxhash64(5, l){long}))"
    lines = docs.select("k1", "k2", "id", F.expr(f"filter({numbered}, x -> x.full)").alias("ls"))
    lines = lines.select("k1", "k2", "id", *[F.col(f"ls.{x}").alias(x) for x in ("i", "h", "g", *(["long"] if long else []))])
    of = lambda name: [f"{name}[s + {j}]" for j in range(window)]
    least = f"array_min(array({', '.join(of('h'))}))"
    # Exploded as "outer", as a filter on the array's size would make the array a second time.
    window_at = f"""case when size(h) >= {window} then transform(sequence(0, size(h) - {window}), s -> named_struct(
        'start', i[s], 'mark', {least}, 'at', s + array_position(array({", ".join(of("h"))}), {least}),
        'a', xxhash64({", ".join(of("h"))}), 'b', xxhash64({", ".join(of("g"))}), 'lines', array({", ".join(of("i"))}))) end"""
    if long_words is not None:
        # Hashes of one line and of several never meet, as they are made of other numbers of values.
        single = "filter(transform(h, (x, s) -> named_struct('start', i[s], 'mark', x, 'at', s + 1L, 'a', xxhash64(x), 'b', xxhash64(g[s]), 'lines', array(i[s]))), (x, s) -> long[s])"
        window_at = f"concat(coalesce({window_at}, array()), {single})"
    return lines.select("k1", "k2", "id", F.explode_outer(F.expr(window_at)).alias("w")).where("w is not null").select("k1", "k2", "id", "w.*")


def repeated_lines(docs: DataFrame, window: int, long_words: int | None = None) -> DataFrame:
    """``k1``, ``k2`` and ``gone``, the numbers of the lines that belong to a later copy, of the documents with any."""
    windows = _windows(docs, window, long_words)
    place = F.struct("id", "k1", "k2", "at")
    marks = windows.groupBy("mark").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("mark")
    # Written before it is joined: a join of its own exchanges can split the rows of a hot line over tasks.
    marks = stage(marks, "marks")
    matched = stage(windows.join(marks, "mark").drop("mark", "at"), "line-windows")
    begin = F.struct("id", "k1", "k2", "start")
    firsts = matched.groupBy("a", "b").agg(F.min(begin).alias("first"), F.max(begin).alias("last")).where("first <> last").select("a", "b", "first")
    firsts = stage(firsts, "firsts")
    later = matched.join(firsts, ["a", "b"]).where(begin > F.col("first"))
    return later.select("k1", "k2", F.explode("lines").alias("i")).groupBy("k1", "k2").agg(F.collect_set("i").alias("gone"))


def remove_repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 2, long_words: int | None = None) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with ``kept_text``, ``n_lines`` and ``n_removed``.

    Lines are split at ``\\n`` and compared exactly. A run of at least ``window`` lines with a word that equals an earlier
    run is deleted; earlier means a smaller id (nulls first), then place in the text. With ``long_words``, a single line of
    at least so many words (``[^\\x20\\x09-\\x0D]+``) that equals an earlier one is deleted as well. Lines without a word do not break
    a run and are never deleted. Rows that repeat in id and text are one document and get one result. A null text stays
    null with 0 lines; an empty text is one line without a word; a document whose lines all go keeps the empty text.
    Other columns are only carried. Empty tables give empty results.
    """
    rows = docs.select(whole(docs), F.col(doc_id).alias("id"), F.col(text).alias("text")).select("row", "id", "text", *keys("id", "text"))
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).select("id", "text", *keys("id", "text"))
    gone = repeated_lines(slim.where("text is not null"), window, long_words)
    joined = rows.join(gone, ["k1", "k2"], "left").select("row", "gone", "text", F.split("text", "\n", -1).alias("ls"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(ls) - 1), gone), i -> ls[i]), '\\n')")
    removed = F.coalesce(F.size("gone"), F.lit(0))
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        F.coalesce(F.size("ls"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"),
    )
