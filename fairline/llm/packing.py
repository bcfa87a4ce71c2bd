"""Packing token sequences by non-negative least squares over length combinations.

Documents are tokenised once; what is longer than a window is cut into full windows and one rest. The histogram of rests
(at most one count for each length, so it fits the driver whatever the corpus) is all that planning needs:

1. Lengths are put into bins of ``GRAIN`` tokens, rounded up. Every combination of at most three bins that fills the
   window exactly is a strategy; non-negative least squares finds how often to repeat each to use up the histogram.
2. Repeat counts are rounded down and never take more than there is. A bin's longest rests are taken first.
3. The rests that are left are packed greedily by their exact lengths, the longest that fits first, whole patterns at once.

The plan says for the i-th rest of a bin which sequence it goes to. Rests get their i from counts for each (length, salt),
so no length, however common, is ranked in one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.common import mapped, stage
from fairline.llm.words import SPACE, parts, slices, word_bounds

GRAIN = 16
CACHED_WORDS = 1_200_000
GROUP_ROWS = 1000  # rests ranked together, about

_loaded: dict = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that lie behind one another, and where each text's words end among them.

    A-Z count as a-z but in a text that may name a special token.
    """
    named = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    folded = _LOWER[data]
    for text in np.unique(np.searchsorted(offsets, named, "right") - 1):
        folded[offsets[text] : offsets[text + 1]] = data[offsets[text] : offsets[text + 1]]
    starts, ends = word_bounds(data, offsets)
    places = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=places[1:])
    held = folded[~SPACE[data]]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(held)])
    return words, np.searchsorted(starts, offsets[1:])


def _encoder(path: str, end_id: int):
    """Texts of a column to their ids, each followed by the end id: runs of (ids of several texts, where each text ends).

    White space separates words in this tokenizer's own rules and is dropped, and letters count as lower-case ones, so a text's
    ids are those of its words with A-Z as a-z. Only a text that may name a special token keeps its capitals. The distinct words of
    a run are looked up, those not met before are encoded, and the ids are gathered from them in one go.
    """
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = (Tokenizer.from_file(path), {})
    tokenizer, known = _loaded[path]
    last = end_id.to_bytes(4, "little")

    def encode(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, data, offsets in slices(column):
            words, ends = _words(data, offsets)
            coded = words.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(known) > CACHED_WORDS:
                known.clear()
            new = [w for w in distinct if w not in known]
            for w, e in zip(new, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
            held = [*map(known.__getitem__, distinct), last]
            values = np.frombuffer(b"".join(held), "<u4")
            sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
            begins = np.cumsum(sizes) - sizes
            # The end of a text is one more word, whose entry is the last.
            order = np.insert(np.asarray(coded.indices, np.int64), ends, len(distinct))
            many = sizes[order]
            upto = np.cumsum(many)
            yield values[np.repeat(begins[order] - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)], upto[ends + np.arange(len(ends))]

    return encode


def _cutter(path: str, window: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, end_id)
        for batch in parts(batches):
            rows, starts, lengths, crcs, totals, pieces, row = [], [], [], [], [], [], 0
            for ids, ends in encode(batch.column("text")):
                begin = 0
                for end in ends.tolist():
                    for start in range(begin, end, window):
                        piece = ids[start : min(start + window, end)]
                        rows.append(row)
                        starts.append(start - begin)
                        lengths.append(len(piece))
                        crcs.append(zlib.crc32(piece))
                        totals.append(end - begin)
                        if keep_ids:
                            pieces.append(piece.tobytes())
                    begin, row = end, row + 1
            columns = [batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.binary())] * keep_ids, ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    return run


def combinations(bins: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0, a < bins and a + b + c = bins; 0 is an empty slot."""
    a, b = np.meshgrid(np.arange(bins), np.arange(bins), indexing="ij")
    c = bins - a - b
    fits = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[fits], b[fits], c[fits]], 1)


def least_squares(uses: np.ndarray, target: np.ndarray, tolerance: float = 1e-4) -> np.ndarray:
    """x >= 0 that minimises |A x - target|; column s of A counts how often row s of ``uses`` names each bin (not 0).

    The active-set method of Lawson and Hanson; columns enter eight at a time.
    """
    strategies, bins = len(uses), len(target)

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros(bins)
        for j in range(uses.shape[1]):
            out += np.bincount(uses[:, j], x, bins)
        out[0] = 0
        return out

    scale = max(1.0, float(target.max(initial=0)))
    goal = target / scale
    goal[0] = 0
    x = np.zeros(strategies)
    active = np.zeros(strategies, bool)
    for _ in range(4 * bins):
        rest = goal - times(x)
        rest[0] = 0
        gain = rest[uses].sum(1)
        gain[active] = 0
        enter = np.argsort(-gain)[:8]
        enter = enter[gain[enter] > tolerance]
        if not len(enter):
            break
        active[enter] = True
        while True:
            on = np.flatnonzero(active)
            dense = np.zeros((bins, len(on)))
            for j in range(uses.shape[1]):
                np.add.at(dense, (uses[on, j], np.arange(len(on))), 1.0)
            dense[0] = 0
            normal = dense.T @ dense + 1e-9 * np.eye(len(on))
            solved = np.linalg.solve(normal, dense.T @ goal)
            if solved.min() > 0:
                x[:] = 0
                x[on] = solved
                break
            low = solved <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(low, x[on] / (x[on] - solved), np.inf)
            x[on] += min(1.0, np.nanmin(step)) * (solved - x[on])
            out = on[low & (x[on] <= 1e-9)]
            if not len(out):
                out = on[[int(np.argmin(solved))]]
            x[out] = 0
            active[out] = False
            if not active.any():
                break
    return x * scale


def plan(counts: np.ndarray, window: int, grain: int = GRAIN) -> dict[str, np.ndarray]:
    """Where rests go. counts[n] is the number of pieces of n tokens, n from 0 to window.

    A bin's pieces are ordered by length, longest first; ``first[n]`` is the place of the first piece of n tokens in its
    bin. Slot (bin, lo, hi, base, each) sends pieces lo <= i < hi of the bin to sequence base + (i - lo) // each.
    """
    bins = window // grain
    bin_of = (np.arange(window + 1) + grain - 1) // grain
    first = np.zeros(window + 1, np.int64)
    for n in range(window - 1, 0, -1):
        if bin_of[n] == bin_of[n + 1]:
            first[n] = first[n + 1] + counts[n + 1]
    # A full window is a sequence of its own and gets the bin after the last.
    bin_of[window], first[window] = bins + 1, 0
    for n in range(window - 1, window - grain, -1):
        first[n] = counts[n + 1 : window].sum()
    totals = np.bincount(bin_of[1:], counts[1:], bins + 2).astype(np.int64)
    slots, made = [], 0
    if counts[window]:
        slots.append((bins + 1, 0, int(counts[window]), 0, 1))
        made = int(counts[window])
    taken = np.zeros(bins + 2, np.int64)
    uses = combinations(bins)
    times = least_squares(uses, totals[:bins].astype(float))
    for s in np.argsort(-times, kind="stable"):
        repeat = int(times[s])
        if repeat < 1:
            break
        parts = [int(b) for b in uses[s] if b]
        repeat = min([repeat, *(int(totals[b] - taken[b]) // parts.count(b) for b in parts)])
        if repeat < 1:
            continue
        for b in dict.fromkeys(parts):
            many = parts.count(b)
            slots.append((b, int(taken[b]), int(taken[b]) + repeat * many, made, many))
            taken[b] += repeat * many
        made += repeat
    left = {n: int(first[n] + counts[n] - max(first[n], min(taken[bin_of[n]], first[n] + counts[n]))) for n in range(1, window)}
    at = {n: int(first[n] + counts[n]) - c for n, c in left.items()}
    there = sorted(n for n, c in left.items() if c)
    while there:
        room, pattern = window, {}
        upto = len(there)
        while room and (upto := bisect_right(there, room, 0, upto)):
            n = there[upto - 1]
            pattern[n] = min(left[n], room // n)
            room -= n * pattern[n]
            upto -= 1
        repeat = min(left[n] // many for n, many in pattern.items())
        for n, many in pattern.items():
            slots.append((int(bin_of[n]), at[n], at[n] + repeat * many, made, many))
            at[n] += repeat * many
            left[n] -= repeat * many
        made += repeat
        gone = {n for n in pattern if not left[n]}
        there = [n for n in there if n not in gone] if gone else there
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return {"bin": table[:, 0], "lo": table[:, 1], "base": table[:, 3], "each": table[:, 4], "first": first, "bin_of": bin_of}


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = 4096, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, packed: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset``, and with ``keep_ids`` the ids themselves (little-endian unsigned 32-bit, binary).

    ``tokenizer`` is the path of a word tokenizer's file that drops white space; ``window`` a multiple of GRAIN. A null or
    empty text is a document of the end id alone. Each row is a document of its own, also when rows repeat or the id is
    null. Longer texts than a window fill whole sequences and one rest. Other columns are not read. An empty table packs
    into no piece. Sequences hold at most ``window`` tokens, without gaps.
    """
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    pieces = mapped(slim, _cutter(tokenizer, window, end_id, keep_ids), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)
    pieces = stage(pieces, "pieces")
    counts = np.zeros(window + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # one row for each length, so at most ``window``
        counts[row["length"]] = row["count"]
    where = plan(counts, window)
    salts = max(1, -(-int(counts.max()) // GROUP_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32", "doc_tokens"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("rows"))
    before = groups.select("length", "salt", (F.sum("rows").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = salted.withColumn("nth", nth).join(before, ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("before"))

    @F.pandas_udf("long")
    def sequence(length: pd.Series, nth: pd.Series) -> pd.Series:
        n = length.to_numpy()
        i = where["first"][n] + nth.to_numpy()
        bins = where["bin_of"][n]
        slot = np.searchsorted(where["bin"] * (1 << 44) + where["lo"], bins * (1 << 44) + i, "right") - 1
        return pd.Series(where["base"][slot] + (i - where["lo"][slot]) // where["each"][slot])

    placed = ranked.withColumn("sequence_id", sequence("length", "nth"))
    in_order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "ids_crc32", "doc_tokens", "nth").rowsBetween(Window.unboundedPreceding, 0)
    offset = F.sum("length").over(in_order) - F.col("length")
    ids = ["ids"] * keep_ids
    return placed.select(F.col("id").alias(doc_id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"), *ids)


def word_tokenizer() -> str:
    """Path of the installed public word tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
