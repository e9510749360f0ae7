"""Polynomial hashes of bytes, words and windows over whole Arrow batches of texts.

A batch's UTF-8 bytes lie in one buffer. Prefix sums of table[byte] * BASE**i modulo 2**64 give the hash of any stretch in
constant time, so the work is a few array passes whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def table(seed: int) -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=_U) * _U(BASE) + _U(seed))


WORD_TABLE = table(1)
LOWER_TABLE = WORD_TABLE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i] is the hash of data[i:j] times BASE**i."""
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * powers(len(data))[0], out=sums[1:])
    return sums


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@dataclass
class Texts:
    """A run of rows of a batch: their bytes and where each begins (one more offset than rows)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_runs(column: pa.Array, run_bytes: int = 1 << 20) -> Iterator[Texts]:
    """The rows of a string column in runs of about run_bytes, a longer text alone; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + run_bytes, "right")) - 1)
        end = min(end, len(column))
        yield Texts(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


@dataclass
class Words:
    """The words of a run of rows: hashes, byte ranges and, per row, where its words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def rows_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words_of(texts: Texts, lower: bool, piece: int = 1 << 20) -> Words:
    """Words between ASCII white space, with A-Z lower-cased if asked.

    Long texts are hashed in pieces cut at white space, so memory beyond 24 bytes a word stays bounded by the piece
    (or by one word longer than it).
    """
    data, values = texts.data, LOWER_TABLE if lower else WORD_TABLE
    gap = IS_SPACE[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    ends = ~gap
    ends[:-1] &= gap[1:]
    full = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    begins[full] = ~gap[full]
    last = texts.offsets[1:][np.diff(texts.offsets) > 0] - 1
    ends[last] = ~gap[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes, at = np.empty(len(starts), _U), 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(stops, low + piece, "right")))
        sums = prefix_sums(data[low : stops[to - 1]], values)
        s, e = starts[at:to] - low, stops[at:to] - low
        hashes[at:to] = mix((sums[e] - sums[s]) * powers(len(sums))[1][s] + (e - s).astype(_U))
        at = to
    return Words(hashes, starts, stops, np.searchsorted(starts, texts.offsets))


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every `size` consecutive entries (those past the end left out)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, _U)
    sums = np.zeros(len(hashes) + 1, _U)
    up, down = powers(len(hashes) + 1)
    np.cumsum(mix(hashes + _U(seed)) * up[: len(hashes)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n] + _U(seed))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
