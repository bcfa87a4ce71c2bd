"""Audit of how filters interact: what every order of five filters removes, step by step, in every part of the corpus.

The files are a stream that is read to its end in micro-batches. Whether a document is a copy depends on all files: of documents
with identical texts only those with the smallest id are no copies, and a smaller id may come in any later file. So

1. every document is counted at once in its part's counters, as failing the copy filter as well,
2. the state of a text, keyed by its SHA-256, is the smallest id so far with what its rows are (part, filters failed, labels). Those
   rows are taken back from the counters and counted as no copies,
3. when a smaller id arrives, the correction of the earlier one is retracted in turn.

A counter is (part, set of filters failed, good, toxic). Every micro-batch writes its changes to the counters under its own number,
so a batch that is run again replaces them. All orders and steps are then arithmetic on 32 counters a part.

State is held in buckets of texts, as one value per bucket, so that Python is called once per bucket and micro-batch. Each Arrow
batch is combined before the shuffle: a text with millions of copies sends one row per batch, not one per copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairline.llm.common import stage
from fairline.session import shared_folder

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
BATCHES = 4  # micro-batches, about; the files are dealt over them
TEXTS = 4096  # texts in a bucket of state, about
_WORD_BREAK = r"[\x20\x09-\x0D]+"
_WHAT = ["part", "mask", "good", "toxic"]
_DELTA = "part string, mask int, good boolean, toxic boolean, n long"
_SLIM = "key binary, id long, " + _DELTA


def failed(text: Column) -> Column:
    """Filters that a text fails by itself, as bits: A 1, B 2, C 4, D 8."""
    words = F.filter(F.split(text, _WORD_BREAK), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    bits = [n < 200, distinct * 100 < n * 50, F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 3, text.rlike(r"[#$%&*|]")]
    return sum(F.when(bit, 1 << i).otherwise(0) for i, bit in enumerate(bits)).cast("int")


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.groupby(_WHAT, as_index=False, sort=True)["n"].sum() if len(rows) else rows[[*_WHAT, "n"]]


def corrections(smallest: pd.DataFrame) -> pd.DataFrame:
    """Changes to the counters for rows that are no copies: one less that fails the copy filter, one more that doesn't."""
    return pd.concat([smallest[[*_WHAT, "n"]], smallest[[*_WHAT, "n"]].assign(mask=smallest["mask"] | COPY, n=-smallest["n"])])


def smallest_ids(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows with the smallest id of their text, equal ones added up."""
    least = rows.groupby("key")["id"].transform("min")
    return rows[rows["id"] == least].groupby(["key", "id", *_WHAT], as_index=False, sort=True)["n"].sum()


def _combined(buckets: int):
    """Rows of each Arrow batch: those with the smallest ids of their texts, and changes to the counters (without a key)."""
    fields = ["key", "id", *_WHAT, "n"]

    def summed(rows: pa.Table, by: list[str]) -> pa.Table:
        return rows.group_by(by).aggregate([("n", "sum")]).rename_columns([*by, "n"]) if rows.num_rows else rows.select([*by, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_arrays(batch.columns, names=batch.schema.names)  # fields may be null from here on
            if not rows.num_rows:
                continue
            named = pc.is_valid(rows["id"])
            mask = pc.if_else(named, pc.bit_wise_or(rows["mask"], pa.scalar(COPY, pa.int32())), rows["mask"])
            counted = summed(rows.set_column(rows.schema.get_field_index("mask"), "mask", mask), _WHAT)
            held = rows.filter(named)
            first = held.group_by("key").aggregate([("id", "min")])
            least = held.join(first, "key") if held.num_rows else held.append_column("id_min", held["id"])
            least = summed(least.filter(pc.equal(least["id"], least["id_min"])), fields[:-1])
            # Changes go to any bucket; the first text's keeps a task that is run again alike, and spreads them.
            place = lambda key: int.from_bytes(key[:8], "little") % buckets
            places = [*map(place, least["key"].to_pylist()), *[place(rows["key"][0].as_py())] * counted.num_rows]
            plain = counted.append_column("key", pa.array([b""] * counted.num_rows, pa.binary())).append_column("id", pa.array([0] * counted.num_rows, pa.int64()))
            out = pa.concat_tables([least.select(fields), plain.select(fields)]).append_column("bucket", pa.array(places, pa.int64()))
            yield from out.select(["bucket", *fields]).combine_chunks().to_batches()

    return run


def _state_bytes(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def update(known: pd.DataFrame | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The state of a bucket after new rows, and the changes to the counters: retractions and additions."""
    if known is None:
        known = rows.iloc[:0]
    touched = known["key"].isin(rows["key"])
    before = known[touched]
    after = smallest_ids(pd.concat([before, rows])) if len(rows) else before
    changes = pd.concat([corrections(after), corrections(before.assign(n=-before["n"]))])
    return pd.concat([known[~touched], after]), changes


def _judge(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    arrived = pd.concat(list(batches))
    plain = arrived["key"].map(len) == 0
    rows = arrived.loc[~plain, ["key", "id", *_WHAT, "n"]]
    known = pa.ipc.open_stream(bytes(state.get[0])).read_pandas() if state.exists else None
    after, changes = update(known, rows)
    state.update((_state_bytes(after),))
    changes = _added(pd.concat([arrived.loc[plain, [*_WHAT, "n"]], changes]))
    yield changes[changes["n"] != 0]


def counters(spark: SparkSession, path: str, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", batches: int = BATCHES) -> DataFrame:
    """Documents by ``part``, ``mask`` (filters failed), ``good`` and ``toxic``, from the Parquet files at ``path``."""
    table = spark.read.parquet(path)
    schema = table.select(doc_id, text, part).schema
    files = max(1, -(-len(table.inputFiles()) // batches))
    buckets = max(64, table.count() // TEXTS)  # counted in the files' footers
    kind = schema[doc_id].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("ids are whole numbers")
    # Rows without an id would meet in one task of the join; they get keys of their own, which no label has.
    facts = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    facts = stage(facts.where("good OR toxic").select("labelled", F.lit(0).alias("spread"), "good", "toxic"), "labels")

    # A pattern, as the path may be one file; only whole folders are watched otherwise.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    content = F.coalesce(F.col(text), F.lit(""))
    slim = stream.select(F.unhex(F.sha2(content, 256)).alias("key"), F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), failed(content).alias("mask"))
    slim = slim.withColumn("spread", F.when(F.col("id").isNull(), F.pmod(F.hash("key"), F.lit(1 << 20)) + 1).otherwise(0))
    known = slim.join(facts, F.coalesce("id", F.lit(0)).eqNullSafe(F.col("labelled")) & (slim["spread"] == facts["spread"]), "left")
    known = known.select("key", "id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), F.lit(1).cast("long").alias("n"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    combined = known.mapInArrow(_combined(buckets), f"bucket long, {_SLIM}")
    changes = combined.groupBy("bucket").applyInPandasWithState(_judge, _DELTA, "texts binary", "update", GroupStateTimeout.NoTimeout)

    folder = f"{shared_folder(spark)}/fairline-audit-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*_WHAT).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    written = spark.read.schema(f"{_DELTA}, batch long").parquet(f"{folder}/changes")
    return written.groupBy(*_WHAT).agg(F.sum("n").alias("n")).where("n <> 0")


def audit(counted: DataFrame) -> DataFrame:
    """Every part, order and step with what the step keeps, removes and loses; see ``filter_interactions``."""
    masks = range(1 << len(FILTERS))
    held = lambda m, when: F.coalesce(F.sum(F.when((F.col("mask") == m) & when, F.col("n"))), F.lit(0).cast("long"))
    parts = counted.groupBy("part").agg(*[F.array(*[held(m, when) for m in masks]).alias(name) for name, when in (("all", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))])
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    steps = parts.select("part", "all", "good", "toxic", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = "shiftleft(1, ascii(substring(filter_order, {}, 1)) - ascii('A'))".format
    steps = steps.withColumn("this", F.expr(bit("step"))).withColumn("before", F.expr(f"aggregate(filter(sequence(1, {len(FILTERS)}), i -> i < step), 0, (x, i) -> x | {bit('i')})"))
    total = lambda counts, when, times="1": F.expr(f"aggregate(sequence(0, {len(masks) - 1}), 0L, (x, m) -> x + if({when}, {counts}[m] * {times}, 0L))")
    removed = "m & this <> 0 and m & before = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("all", "m & (before | this) = 0").alias("kept"), total("all", removed).alias("removed"),
        total("all", "m & this <> 0 and m & before <> 0").alias("redundant"), total("all", "m = this").alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        # Of all orders, one in as many as a document fails filters has this filter first among them.
        total("all", "m & this <> 0", f"({len(list(permutations(FILTERS)))} div greatest(bit_count(m), 1))").alias("shapley"),
    )


def filter_interactions(spark: SparkSession, path: str, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", batches: int = BATCHES) -> DataFrame:
    """``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``.

    ``path`` names a Parquet file or folder of documents, ``labels`` holds ``doc_id``, ``quality`` and ``toxic``; a document with
    several labels is good or toxic if any says so. Filters: A fewer than 200 words, B 100 * distinct words < 50 * words, C 100 *
    A-Z > 3 * code points, D any of ``#$%&*|``, E the same text as a smaller id. A null text is empty, a null part the
    empty string. A row without an id is no copy and makes no other row one; rows that repeat in id and text are no copies of one
    another. Every step of all 120 orders is a row, zeros included; a table without rows gives none. Other columns are not read.
    """
    return audit(counters(spark, path, labels, doc_id, text, part, batches))
