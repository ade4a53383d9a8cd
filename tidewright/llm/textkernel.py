"""Array kernels over Arrow text columns: words, hashes and word shingles without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 500_000
BATCH_ROWS = 2_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_SEEDS = np.random.default_rng(20240229)
_BYTE_VALUES = _SEEDS.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _SEEDS.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most BATCH_ROWS rows: what a worker builds from texts follows the slice."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        for name, base in (("_powers", _MULTIPLIER), ("_inverse_powers", _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers[:n], _inverse_powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the place where each row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if places is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``most`` bytes (or one longer row): first row, last row + 1, bytes, row starts."""
    raw, offsets = raw_text(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        stop = min(stop, rows)
        yield row, stop, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_spans(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the index of each row's first word (one more at the end)."""
    return _spans(~SPACES[text], starts)


def letter_spans(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of runs of letters: A-Z, a-z and whatever is not ASCII."""
    return _spans(LETTERS[text], starts)


def _spans(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    first, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return first, end, np.searchsorted(first, starts)


def word_hashes(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lowered), and the index of each row's first word."""
    first, end, row_starts = word_spans(text, starts)
    if not len(first):
        return np.zeros(0, np.uint64), row_starts
    powers, inverses = _power_tables(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[LOWER[text]] * powers[:-1], out=sums[1:])
    return mix((sums[end] - sums[first]) * inverses[first] + (end - first).astype(np.uint64)), row_starts


def shingle_sets(text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and where each row's set starts.

    Rows of fewer than ``width`` words have their whole sequence as the one shingle; rows without words have none.
    """
    words, row_starts = word_hashes(text, starts)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        rolled[: n - k] += words[k:] * _STEPS[k]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(row_starts[:-1].tolist(), row_starts[1:].tolist()):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif b > a:
            parts = np.append(words[a:b] * _STEPS[: b - a], _STEPS[-(b - a)])
            sets.append(mix(parts.sum(dtype=np.uint64, keepdims=True)))
        else:
            sets.append(rolled[:0])
    places = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=places[1:])
    return (np.concatenate(sets) if sets else rolled[:0]), places
