"""Hashing of words and word shingles over whole Arrow columns; runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 19  # bytes hashed at once, to bound temporary arrays
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.RandomState(20240607).randint(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]  # A-Z count as a-z
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that what is made from one stays small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about SLICE_BYTES; a longer text is a run of its own.

    Null texts have no bytes.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = pa.concat_arrays([column])  # drops any offset
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            values = np.full(size, base, U)
            values[0] = 1
            _powers[name] = np.cumprod(values, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of texts that lie behind one another."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~SPACE[data]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    last = np.ones(n, bool)
    last[:-1] = ~word[1:] | first[1:]
    return starts, np.flatnonzero(word & last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (with ``fold``, A-Z as a-z), and where each text's words start among them."""
    n = len(data)
    if not n:
        return np.empty(0, U), np.zeros(len(offsets), np.int64)
    starts, ends = word_bounds(data, offsets)
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, U)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(_BASE))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, no word gives none."""
    for _, data, offsets in slices(column):
        words, at = word_hashes(data, offsets)
        if len(words) >= k:
            rolled = np.full(len(words) - k + 1, k, U)
            for j in range(k):
                rolled = mix(rolled * U(_BASE) + words[j : j + len(rolled)])
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                short = np.full(1, b - a, U)
                for j in range(a, b):
                    short = mix(short * U(_BASE) + words[j : j + 1])
                yield short
            else:
                yield np.empty(0, U)
