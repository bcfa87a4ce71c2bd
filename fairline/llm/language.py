"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A letter trigram is bound into one vector: the first letter's vector
rotated by two places, times the second's rotated by one, times the third's. A text is the sum (bundle) of its trigrams'
vectors, a language's prototype the sum over its training texts, and a text gets the language whose prototype has the
largest cosine with it, after what all languages have in common is taken off the prototypes.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import mapped
from fairline.llm.words import parts

DIMENSIONS = 1024
SYMBOLS = 64  # 0 is the gap between words
_TABLE_SIZE = 0x110000  # every code point
_SLICE_CHARS = 1 << 19
STEP = 2.0**-10  # scores are counted by steps of this size to find their limits; exact in binary
SIZE_CLASSES = 32  # texts have less than 2**31 letters
_SEED = 20240607
_ready: dict = {}


def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 if it isn't a letter; a-z and the accented letters below U+0180 as far as symbols go,
    other letters by their remainder."""
    if "symbols" not in _ready:
        table = np.zeros(_TABLE_SIZE, np.uint8)
        own: dict[str, int] = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzäöüßáéíóúñàâçèêëîïôùûœæåøãõ")}
        for point in range(_TABLE_SIZE):
            letter = chr(point)
            if unicodedata.category(letter)[0] == "L":
                low = letter.lower()[0]
                table[point] = own.get(low) or 1 + len(own) + ord(low) % (SYMBOLS - 1 - len(own))
        _ready["symbols"] = table
    return _ready["symbols"]


def trigram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bound vectors of trigram codes (a * SYMBOLS + b) * SYMBOLS + c, as float32."""
    letters = np.where(np.random.RandomState(_SEED).rand(SYMBOLS, dimensions) < 0.5, -1, 1).astype(np.int8)
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return (np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]).astype(np.float32)


def _counted(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, trigram codes in use, counts of each text by code) of runs of texts; whole texts are read."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end] or "") <= _SLICE_CHARS):
            size += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[begin:end]]
        points = np.frombuffer("\n".join([*part, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = _symbols()
        symbol = table[points]
        ends = np.cumsum([len(t) + 1 for t in part])
        text = np.repeat(np.arange(len(part)), np.diff(ends, prepend=0))
        keep = symbol > 0
        keep[1:] |= symbol[:-1] > 0  # one gap after each word
        keep[ends - 1] = True
        symbol, text = symbol[keep].astype(np.int32), text[keep]
        # A gap before the first word: the newline that ends the text before it; the first text gets one put before it.
        symbol, text = np.concatenate([[0], symbol]).astype(np.int32), np.concatenate([[0], text])
        code = (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]
        whole = symbol[1:-1] > 0  # a word's letters, with a gap at most at either side
        code, owner = code[whole], text[1:-1][whole]
        used = np.flatnonzero(np.bincount(code, minlength=SYMBOLS**3))
        place = np.zeros(SYMBOLS**3, np.int32)
        place[used] = np.arange(len(used))
        counts = np.bincount(owner * max(1, len(used)) + place[code], minlength=len(part) * max(1, len(used))) if len(used) else np.zeros(len(part))
        yield begin, end, used, counts.reshape(len(part), -1).astype(np.float32)
        begin = end


def _bundler(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in parts(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for begin, end, used, counts in _counted(batch.column("text").to_pylist()):
                vectors = trigram_vectors(used, dimensions)
                share = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # a text's length doesn't weigh
                for lang in set(langs[begin:end]):
                    total = share[langs[begin:end] == lang].sum(0)
                    if total.any():
                        sums[lang] = sums.get(lang, 0) + total.astype(np.float64) @ vectors
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n in names for _ in range(dimensions)], pa.string()), pa.array(list(range(dimensions)) * len(names), pa.int32()), pa.array(np.concatenate([sums[n] for n in names]) if names else [], pa.float64())],
            ["lang", "at", "value"],
        )

    return run


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each language, from all rows that have a text and a language.

    A task sends one vector for each language it met, so what the driver gets is languages x dimensions numbers.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sums = mapped(rows, _bundler(dimensions), "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in sums.collect():
        found.setdefault(row["lang"], np.zeros(dimensions))[row["at"]] = row["value"]
    return found


def _judge(prototypes: dict[str, np.ndarray], dimensions: int, text: str):
    names = sorted(prototypes)
    profile = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names], np.float32).reshape(len(names), dimensions)
    common = profile.mean(0) if len(names) > 1 else np.zeros(dimensions, np.float32)
    centred = profile - common
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            lang: list[str] = []
            score: list[float] = []
            letters: list[int] = []
            own = batch.column("text") if "text" in batch.schema.names else batch.column("row").field(text)
            for _, _, used, counts in _counted(own.to_pylist()):
                bundle = counts @ trigram_vectors(used, dimensions) if len(used) else np.zeros((len(counts), dimensions), np.float32)
                size = np.linalg.norm(bundle, axis=1)
                none = counts.sum(1) == 0 if len(used) else np.ones(len(counts), bool)
                if not names:
                    none[:] = True
                best = np.zeros(len(counts), int) if not names else np.argmax(bundle @ centred.T, 1)
                cosine = np.zeros(len(counts)) if not names else (bundle * profile[best]).sum(1) / np.maximum(size, 1e-12)
                lang += ["und" if u else names[b] for u, b in zip(none, best, strict=True)]
                score += [0.0 if u else float(min(1.0, max(0.0, c))) for u, c in zip(none, cosine, strict=True)]
                letters += counts.sum(1, dtype=np.float64).astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.int64())], ["row", "lang_pred", "score", "n_letters"])

    return run


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", carry: list[str] | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` (all columns, or those in ``carry``) with ``lang_pred``, ``score`` and ``n_letters``.

    ``score`` is the cosine with the language's prototype, 0 to 1; ``n_letters`` is the number of trigrams, one for each letter. A null text, one without a letter, or any text if no
    language was learned gets ``und`` and 0. Only the text is looked at; ties go to the first language by name. Repeated
    rows get equal results, empty tables empty ones.
    """
    kept = docs.columns if carry is None else carry
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *([] if text in kept else [F.col(text).alias("text")]))
    kind = slim.schema["row"].dataType.simpleString()
    return mapped(slim, _judge(prototypes, dimensions, text), f"row {kind}, lang_pred string, score double, n_letters long")


def size_class(n_letters: str = "n_letters") -> Column:
    """The power of two that a number of letters reaches."""
    return F.length(F.bin(n_letters)) - 1


def score_limits(judged: DataFrame, least: float, lang: str = "row.lang", per_mille: int = 1, rows: int = 100) -> dict[int, float]:
    """The lowest score of a text in a language, by size class, learned from the rows recognised as what their label says.

    The limit of a class is the ``per_mille`` quantile (rounded down to STEP) of its labelled rows. A class with fewer than ``rows``
    rows takes in the next shorter ones, whose scores are lower; if all of them are too few, the limit is ``least``, which is
    also the lowest. The driver gets counts by class and step of the score, not by rows.
    """
    right = judged.where((F.col(lang) == F.col("lang_pred")) & (F.col("n_letters") > 0))
    held: dict[int, dict[int, int]] = {}
    for at, step, n in right.groupBy(size_class().alias("at"), F.floor(F.col("score") / STEP).alias("step")).count().collect():
        held.setdefault(at, {})[step] = n
    limits: dict[int, float] = {}
    for at in range(SIZE_CLASSES):
        found: Counter[int] = Counter()
        for shorter in range(at, -1, -1):
            found.update(held.get(shorter, {}))
            if found.total() >= rows:
                break
        limits[at] = least
        if found.total() >= rows:
            under = found.total() * per_mille // 1000
            for step in sorted(found):
                under -= found[step]
                if under < 0:
                    limits[at] = max(least, step * STEP)
                    break
    return limits


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
