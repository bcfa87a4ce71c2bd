"""Suffix dedup: bytes covered by strings of ``length`` bytes that begin more than once in the corpus.

A global suffix order of 100 TB is not needed to know which strings repeat. The work is dealt out so that equal strings meet:

1. The fingerprint of a string is the smallest hash of the GRAM-byte strings in it, so equal strings have equal fingerprints.
   Neighbouring strings mostly share theirs: a text becomes runs of strings with one fingerprint. Fingerprints that occur
   once are dropped, which is most of the corpus; no repeat can be among them.
2. What is left of a text is cut into segments, one for each run. Equal segments are one row with their number (also those
   of equal texts, which are one text to begin with), so hot passages are collapsed before anything is sorted.
3. Segments that share a fingerprint are sorted together: their shards' Burrows-Wheeler transforms are merged by iterative
   interleave refinement (``bwt``), which gives the intervals of suffixes that have ``length`` bytes in common.
4. A fingerprint with more segment bytes than HOT_BYTES would not fit a task. Its strings are counted by a 128-bit hash,
   with a shuffle on that hash, instead.
5. The repeated strings' bytes are joined up per text and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.bwt import repeated_starts, rolling
from fairline.llm.common import mapped, release, stage
from fairline.llm.words import U, mix, parts

GRAM = 32
BLOCK = 50
CHUNK_BYTES = 1 << 18  # segments sorted together, about
TASK_BYTES = 4 << 20
HOT_BYTES = 1 << 20
_PIECE = 1 << 17  # strings of a long text looked at together


def _minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    out, span = hashes, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    n = len(hashes) - width + 1
    return np.minimum(out[:n], out[width - span : width - span + n])


def _runs(text: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, strings, fingerprint, weight) of the runs; weight counts the places of the fingerprint's bytes in a run."""
    width = length - GRAM + 1
    for at in range(0, len(text) - length + 1, _PIECE):
        hashes = rolling(text[at : at + _PIECE + length - 1], GRAM)
        least = _minima(hashes, width)
        begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        strings = np.diff(np.append(begin, len(least)))
        print_ = least[begin]
        # A run's strings span its grams from begin to begin + strings + width - 2.
        owner = np.repeat(np.arange(len(begin)), strings + width - 1)
        first = np.cumsum(strings + width - 1) - (strings + width - 1)
        gram = np.arange(len(owner)) - first[owner] + begin[owner]
        weight = np.bincount(owner, hashes[gram] == print_[owner], len(begin)).astype(np.int32)
        yield at + begin, strings, print_, weight


def _fingerprints(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 128):
            rows, columns = [], [[], [], [], []]
            for row, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for found in _runs(data, length):
                    rows.append(np.full(len(found[0]), row))
                    for held, new in zip(columns, found, strict=True):
                        held.append(new)
            if rows:
                begin, strings, print_, weight = (np.concatenate(c) for c in columns)
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("t1").take(take), batch.column("t2").take(take), pa.array(begin, pa.int64()), pa.array(strings.astype(np.int32)), pa.array(print_.view(np.int64)), pa.array(weight)],
                    ["t1", "t2", "at", "n", "f", "weight"],
                )

    return run


def _cut(length: int):
    """A segment for each of a text's ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 64):
            out = [[], [], [], [], [], [], [], []]
            for t1, t2, text, runs, copies in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), batch.column("text"), batch.column("runs").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                data = bytes(text.as_buffer())
                for r in runs:
                    segment = data[r["at"] : r["at"] + r["n"] + length - 1]
                    digest = hashlib.blake2b(segment, digest_size=16).digest()
                    for held, new in zip(out, (t1, t2, r["at"], copies, r["weight"], r["f"], digest, segment), strict=True):
                        held.append(new)
            kinds = [pa.int64()] * 6 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["t1", "t2", "at", "copies", "weight", "f", "s", "segment"])

    return run


def _intervals(flags: np.ndarray, length: int) -> list[int]:
    """Begin and end, in turn, of the bytes covered by the strings that begin where flagged."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(at) > length]))
    ends = at[np.append(new[1:], len(at)) - 1] + length
    return np.stack([at[new], ends], 1).reshape(-1).tolist()


def _merged(length: int, block: int, chunk: int):
    """Covered bytes of segments; rows come sorted by fingerprint, and all of a fingerprint's are in one partition."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"\0".join([*(h[1] for h in held), b""]), np.uint8)
        offsets = np.cumsum([0, *(len(h[1]) + 1 for h in held)])
        flags = repeated_starts(data, offsets, length, block)
        covers = [_intervals(flags[a:b], length) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.binary()), pa.array(covers, pa.list_(pa.int64()))], ["s", "covered"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for f, s, segment in zip(*(batch.column(c).to_pylist() for c in ("f", "s", "segment")), strict=True):
                if f != last and size >= chunk:
                    yield solve(held)
                    held, size = [], 0
                held.append((s, segment))
                size += len(segment)
                last = f
        if held:
            yield solve(held)

    return run


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            for s, segment in zip(batch.column("s"), batch.column("segment"), strict=True):
                data = np.frombuffer(segment.as_buffer(), np.uint8)
                hashes = rolling(data, length)
                other = rolling(mix(data.astype(U) + U(77)) & U(0xFF), length)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(other.view(np.int64)), pa.array([s.as_py()] * len(hashes), pa.binary()), pa.array(np.arange(len(hashes)), pa.int64())], ["h1", "h2", "s", "at"])

    return run


def _joined(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covers = []
            for at in batch.column("at").to_pylist():
                flags = np.zeros(max(at) + 1, bool)
                flags[at] = True
                covers.append(_intervals(flags, length))
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(covers, pa.list_(pa.int64()))], ["s", "covered"])

    return run


def _removed():
    """Texts without their covered bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 64):
            kept, removed, spans = [], [], []
            for text, covered in zip(batch.column("text"), batch.column("covered").to_pylist(), strict=True):
                data, merged = bytes(text.as_buffer()), []
                for a, b in sorted((p["a"], p["b"]) for p in covered):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                cuts = [0, *(x for m in merged for x in m), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                removed.append(sum(b - a for a, b in merged))
                spans.append(len(merged))
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["t1", "t2", "kept", "n_removed", "n_spans"])

    return run


def _covered_by_segment(segments: DataFrame, length: int, hot_bytes: int) -> DataFrame:
    """``s`` and ``covered`` of the distinct segments (``f``, ``s``, ``segment``, ``many``, ``weight``)."""
    groups = segments.groupBy("f").agg(F.count("*").alias("segments"), F.sum(F.length("segment")).alias("bytes"), F.max("weight").alias("weight"))
    groups = stage(groups, "groups")
    # A segment that occurs several times is covered whole; it still bears witness for the others of its fingerprint.
    sure = segments.where("many > 1").select("s", F.array(F.lit(0).cast("long"), F.length("segment").cast("long")).alias("covered"))
    rows = segments.select("f", "s", "segment", "many")
    met = rows.join(groups.where(f"(segments > 1 or weight > 1) and bytes <= {hot_bytes}").select("f", "bytes"), "f")
    size = groups.where(f"(segments > 1 or weight > 1) and bytes <= {hot_bytes}").agg(F.sum("bytes")).first()[0] or 0
    dealt = met.select("f", "s", "segment").repartition(max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // TASK_BYTES), "f").sortWithinPartitions("f", "s")
    found = mapped(dealt, _merged(length, BLOCK, CHUNK_BYTES), "s binary, covered array<long>")
    hot = groups.where(f"bytes > {hot_bytes}").select("f")
    if not hot.isEmpty():
        strings = stage(mapped(rows.join(hot, "f").select("s", "segment", "many"), _strings(length), "h1 long, h2 long, s binary, at long"), "strings")
        twice = strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
        twice = stage(twice, "twice")
        places = strings.join(twice, ["h1", "h2"]).groupBy("s").agg(F.collect_list("at").alias("at"))
        found = found.union(mapped(places, _joined(length), "s binary, covered array<long>"))
    return sure.union(found.where("size(covered) > 0"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.select("id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(0x5BD1E995), F.col("text")).alias("t2"), F.length("text").cast("long").alias("n_bytes"))


def cut_texts(rows: DataFrame, length: int = 200, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``t1``, ``t2``, ``kept``, ``n_removed``, ``n_spans`` of the distinct texts that lose bytes."""
    long_ = rows.where(f"n_bytes >= {length}")
    texts = stage(long_.groupBy("t1", "t2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "texts")
    runs = stage(mapped(long_.select("t1", "t2", "text"), _fingerprints(length), "t1 long, t2 long, at long, n int, f long, weight int"), "runs")
    shared = runs.groupBy("f").agg(F.sum("weight").alias("all")).where("all > 1").select("f")
    shared = stage(shared, "shared")  # so that the join has exchanges of its own and can split a hot fingerprint
    marked = runs.join(shared, "f").groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "n", "f", "weight")).alias("runs"))

    # Of equal texts one is cut up, for all.
    once = long_.join(marked.join(texts, ["t1", "t2"]), ["t1", "t2"]).where(F.col("id").eqNullSafe(F.col("rep")))
    once = stage(once.select("t1", "t2", "text", "runs", "copies").dropDuplicates(["t1", "t2"]), "marked")
    release(texts, runs, shared)
    pieces = stage(mapped(once, _cut(length), "t1 long, t2 long, at long, copies long, weight long, f long, s binary, segment binary"), "segments")
    segments = stage(pieces.groupBy("f", "s").agg(F.first("segment").alias("segment"), F.sum("copies").alias("many"), F.max("weight").alias("weight")), "distinct")
    places = stage(pieces.select("s", "t1", "t2", "at"), "places")
    release(pieces)
    by_segment = stage(_covered_by_segment(segments, length, hot_bytes), "covered")
    release(segments)

    pair = F.explode(F.expr("transform(sequence(0, size(covered) - 1, 2), i -> named_struct('a', at + covered[i], 'b', at + covered[i + 1]))"))
    by_text = places.join(by_segment, "s").select("t1", "t2", pair.alias("p")).groupBy("t1", "t2").agg(F.collect_set("p").alias("covered"))
    return mapped(once.select("t1", "t2", "text").join(by_text, ["t1", "t2"]), _removed(), "t1 long, t2 long, kept binary, n_removed long, n_spans long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, hot_bytes: int = HOT_BYTES, digests: bool = False) -> DataFrame:
    """A row for each row of ``docs``: ``id``, ``kept`` (the bytes left, UTF-8 unless a cut parts a character), ``n_bytes``,
    ``n_removed`` and ``n_spans`` (maximal removed runs). With ``digests``, ``kept`` is the SHA-256 of these bytes, and texts
    that lose nothing needn't be moved.

    Texts are UTF-8 bytes; null is empty. A byte goes if any string of ``length`` bytes over it begins at another place too, in
    this or any row; rows that repeat in id and text are rows of their own, so both lose all from ``length`` bytes on.
    ``length`` is a multiple of 50. Shorter texts stay whole. Other columns are not read. Empty tables give empty results.
    """
    rows = _rows(docs, doc_id, text)
    cut = cut_texts(rows, length, hot_bytes)
    if digests:
        rows, cut = rows.withColumn("text", F.sha2("text", 256)), cut.withColumn("kept", F.sha2("kept", 256))
    none = F.lit(0).cast("long")
    return rows.join(cut, ["t1", "t2"], "left").select("id", F.coalesce("kept", "text").alias("kept"), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"))
