"""Quality rules by distribution divergence.

Two histograms of a document are compared with those of each language: character classes, and the language's common
words (those that make up at least one in COMMON_SHARE of its words, whatever their length, and all others together). The distance to a
language is the mean of both Jensen-Shannon distances (base 2, so 0 to 1). A document far from all languages is dropped;
one with fewer than ``min_words`` words is too short for histograms and is left to the plain rules.

Language histograms are counted over all labelled documents: words by hash within tasks, which send their counts on whenever they
hold HELD_WORDS distinct words, so neither memory nor shuffle depends on a bound on words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import mapped
from fairline.llm.words import U, mix, parts, slices, word_hashes

COMMON_SHARE = 500
HELD_WORDS = 1 << 20  # distinct words of a language that a task counts before it sends them on
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_DISTANCE = 0.31
_CLASSES = 7

_CLASS = np.full(256, 6, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 punctuation, 5 other ASCII, 6 beyond ASCII
_CLASS[:128] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_LEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_SPACE = _CLASS == 3
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_BLANK = " \t\n\v\f\r"


@dataclass
class Language:
    """Histograms of a language: shares of the character classes, and of its common words (by hash, ascending) and the rest."""

    classes: np.ndarray
    words: np.ndarray
    shares: np.ndarray


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lead = _LEADS[data]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[lead]
    return np.bincount(text * _CLASSES + _CLASS[data][lead], minlength=(len(offsets) - 1) * _CLASSES).reshape(-1, _CLASSES)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes: dict[str, np.ndarray] = {}
    words: dict[str, list] = {}
    totals: dict[str, int] = {}

    def merged(held: list) -> list:
        keys, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        return [(keys, np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64))]

    def counted(lang: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(["word"] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "kind", "key", "n"])

    for batch in parts(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, data, offsets in slices(batch.column("text")):
            own = langs[first : first + len(offsets) - 1]
            hashes, at = word_hashes(data, offsets, fold=False)
            counts = _class_counts(data, offsets)
            text = np.repeat(np.arange(len(own)), np.diff(at))
            for lang in set(own):
                mine = own == lang
                classes[lang] = classes.get(lang, 0) + counts[mine].sum(0)
                totals[lang] = totals.get(lang, 0) + int(np.diff(at)[mine].sum())
                held = words.setdefault(lang, [])
                held.append(np.unique(hashes[mine[text]], return_counts=True))
                if len(held) > 40:
                    words[lang] = merged(held)
                    if len(words[lang][0][0]) >= HELD_WORDS:
                        yield counted(lang, *words.pop(lang)[0])
    for lang in sorted(classes):
        if lang in words:
            yield counted(lang, *merged(words[lang])[0])
        rest = [*classes[lang].tolist(), totals[lang]]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rest), pa.string()), pa.array(["class"] * _CLASSES + ["total"]), pa.array([*range(_CLASSES), 0], pa.int64()), pa.array(rest, pa.int64())], ["lang", "kind", "key", "n"])


def references(labelled: DataFrame, lang: str = "lang", text: str = "text") -> list[Language]:
    """Histograms of each language over all rows with a text and a language; the driver gets at most COMMON_SHARE words
    for each."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = mapped(rows, _counter, "lang string, kind string, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    totals = counts.where("kind = 'total'").select("lang", F.col("n").alias("total"))
    common = counts.join(F.broadcast(totals), "lang").where(f"kind = 'class' or kind = 'word' and n * {COMMON_SHARE} >= total")  # a row for each language
    found: dict[str, dict] = {}
    for row in common.collect():
        held = found.setdefault(row["lang"], {"class": {}, "word": {}, "total": row["total"]})
        held[row["kind"]][row["key"]] = row["n"]
    out = []
    for _, held in sorted(found.items()):
        if not held["total"]:
            continue
        words = np.array(list(held["word"]), np.int64).view(U)
        order = np.argsort(words)
        counts_ = np.array(list(held["word"].values()), float)[order]
        shares = np.append(counts_, held["total"] - counts_.sum()) / held["total"]
        classes = np.array([held["class"].get(i, 0) for i in range(_CLASSES)], float)
        out.append(Language(classes / classes.sum(), words[order], shares))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of ``p`` and ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _repeated(words: np.ndarray) -> int:
    """Words that lie in a 3-word window that occurs at least twice."""
    if len(words) < 4:
        return 0
    window = mix(mix(mix(words[:-2]) + words[1:-1]) + words[2:])
    _, at, counts = np.unique(window, return_inverse=True, return_counts=True)
    hit = np.zeros(len(words), bool)
    begin = np.flatnonzero(counts[at] > 1)
    hit[begin] = hit[begin + 1] = hit[begin + 2] = True
    return int(hit.sum())


def _same_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


def _rules(languages: list[Language], min_words: int, max_repeated: int, max_distance: float):
    known = np.unique(np.concatenate([v.words for v in languages])) if languages else np.empty(0, U)
    columns = [np.searchsorted(known, v.words) for v in languages]

    def distances(hashes: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        total = np.maximum(np.diff(at), 1)[:, None]
        text = np.repeat(np.arange(n), np.diff(at))
        place = np.searchsorted(known, hashes)
        place[place == len(known)] = 0
        hit = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
        counts = np.bincount(text[hit] * max(1, len(known)) + place[hit], minlength=n * max(1, len(known))).reshape(n, -1) / total
        shares = classes / np.maximum(classes.sum(1, keepdims=True), 1)
        best = np.full(n, np.inf)
        for language, own in zip(languages, columns, strict=True):
            words = counts[:, own] if len(own) else np.zeros((n, 0))
            words = np.concatenate([words, np.clip(1 - words.sum(1, keepdims=True), 0, 1)], 1)
            best = np.minimum(best, (js_distance(shares, language.classes[None]) + js_distance(words, language.shares[None])) / 2)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            texts = batch.column("text").to_pylist()
            for first, data, offsets in slices(batch.column("text")):
                hashes, at = word_hashes(data, offsets, fold=False)
                n_words = np.diff(at)
                repeated = np.array([_repeated(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
                failed = (n_words < min_words) | (100 * repeated > max_repeated * n_words)
                far = distances(hashes, at, _class_counts(data, offsets))
                same = np.array([_same_lines(t) for t in texts[first : first + len(n_words)]], np.int64)
                columns = (n_words, _per_text(~_SPACE[data] & _LEADS[data], offsets), _per_text(_SYMBOL[data], offsets), same, repeated, failed, far)
                for held, new in zip(out, columns, strict=True):
                    held.append(new)
            n_words, chars, symbols, same, repeated, failed, far = (np.concatenate(x) for x in out)
            judged = np.isfinite(far) & (n_words >= min_words)
            kept = ~failed & (~judged | (far <= max_distance))
            numbers = [pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols, same, repeated)]
            distance = pa.array(np.where(judged, far, 0.0), pa.float64(), mask=~judged)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *numbers, pa.array(failed), distance, pa.array(kept)], ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"])

    return run


def judge_quality(docs: DataFrame, languages: list[Language], text: str = "text", carry: list[str] | None = None, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED_PERCENT, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``distance`` (to the nearest language; null where not judged) and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words and fails the base rules (fewer than ``min_words``
    words, or more than ``max_repeated`` per cent of words in repeated 3-word windows). Without languages only the base
    rules decide. Repeated rows get equal results; empty tables empty ones.
    """
    kept = docs.columns if carry is None else carry
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).alias("text"))
    kind = slim.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, distance double, kept boolean"
    return mapped(slim, _rules(languages, min_words, max_repeated, max_distance), schema)
