"""Winnowed anchors: stretches of a text such that equal windows lie in stretches with equal anchors.

A window of `window` units (bytes or words) holds window - seed + 1 seeds; the one with the least hash (the leftmost of
several) is its anchor. Equal windows choose the same anchor at the same offset, so whatever repeats can be found by looking at
one anchor's occurrences at a time. Neighbouring windows with one anchor form a stretch: about one in (window - seed) / 2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlweave.llm.hashing import mix, powers, signed
from crawlweave.llm.staging import staged

_U = np.uint64
#: Windows handled at a time; only a text longer than this is cut, which costs exact comparisons there but loses nothing.
CHUNK = 1 << 18
LAST = (1 << 63) - 1


def stretches(values: np.ndarray, offsets: np.ndarray, window: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window's place in the row, number of windows, anchor hash, hash of the whole stretch) of a run of rows.

    values: one 64-bit hash per unit; offsets: where each row's units begin.
    """
    windows = len(values) - window + 1
    step = CHUNK if windows > 2 * CHUNK else max(windows, 1)
    for low in range(0, windows, step):
        own = values[low : min(low + step, windows) + window - 1]
        n = len(own) - window + 1
        sums = np.zeros(len(own) + 1, _U)
        np.cumsum(own * powers(len(own))[0], out=sums[1:])
        down = powers(len(own) + 1)[1]
        seeds = mix((sums[seed:] - sums[:-seed]) * down[: len(own) - seed + 1])
        # the place in the low bits makes the least key the leftmost least seed
        bits = _U(max(len(seeds) - 1, 1).bit_length())
        keys = ((seeds >> bits) << bits) | np.arange(len(seeds), dtype=_U)
        width, covered = window - seed + 1, 1
        while covered < width:
            more = min(covered, width - covered)
            keys = np.minimum(keys[:-more], keys[more:])
            covered += more
        anchor = (keys & ((_U(1) << bits) - _U(1))).astype(np.int64)
        place = np.arange(low, low + n)
        row = np.searchsorted(offsets, place, "right") - 1
        good = place + window <= offsets[row + 1]
        place, row, anchor = place[good], row[good], anchor[good]
        if not len(place):
            continue
        new = np.ones(len(place), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(place)))
        at, row = place[first] - low, row[first]
        ends = at + count + window - 1
        whole = mix((sums[ends] - sums[at]) * down[at] + count.astype(_U))
        yield row, at + low - offsets[row], count, seeds[anchor[first]], whole


#: Columns of the stretch tables: anchor, hash of the stretch, document order key, row key, first window, windows.
FOUND = "h bigint, c bigint, d bigint, k bigint, p int, n int"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, d (doc_id, null last), k (hash of the row), text. Equal rows have equal keys and so equal results."""
    text = F.col("text").cast("string")
    d = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    return docs.select("doc_id", d.alias("d"), F.xxhash64(F.col("doc_id"), text).alias("k"), text.alias("text"))


def find_stretches(texts: DataFrame, units: Callable, window: int, seed: int) -> DataFrame:
    """All stretches of keyed texts; units(column) yields (first row, unit hashes, offsets)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, values, offsets in units(batch.column(2)):
                for row, place, count, anchor, whole in stretches(values, offsets, window, seed):
                    row = row + first
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(anchor), signed(whole), d[row], k[row], place.astype(np.int32), count.astype(np.int32))], ["h", "c", "d", "k", "p", "n"])

    return texts.select("d", "k", "text").mapInArrow(find, FOUND)


def split_by_repetition(texts: DataFrame, units: Callable, window: int, seed: int, across: bool) -> tuple[DataFrame, DataFrame]:
    """(known, open): stretches that occurred whole before, and those only parts of which may have.

    `across` asks for repetition in documents with a smaller d; otherwise any earlier place (d, k, p) counts. An anchor that
    occurs once (in one document, with `across`) is dropped by counts, with partial sums before the shuffle. Of each
    distinct stretch all but the earliest occurrences are known to repeat. The earliest ones are open if their anchor has
    other stretches too. Open stretches of one anchor are all that a window of theirs can still be found in.
    """
    found = find_stretches(texts, units, window, seed)
    place = F.col("d") if across else F.struct("d", "k", "p")
    per = found.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), *([F.min("d").alias("d1"), F.max("d").alias("d2")] if across else [F.count("*").alias("m")]))
    shared = per.where("d1 < d2" if across else "m > 1").select("h", (F.col("c1") != F.col("c2")).alias("several"))
    # written first, so that both sides of the joins are plain shuffles, of which a hot key's partitions can be split
    rows = staged(found.join(staged(shared, "shared"), "h"), "stretches")
    first = staged(rows.groupBy("h", "c").agg(F.min(place).alias("first")), "first")
    judged = rows.join(first, ["h", "c"]).withColumn("later", place > F.col("first"))
    judged = staged(judged.drop("first"), "judged")
    return judged.where("later").select("d", "k", "p", "n"), judged.where("not later and several").select("h", "d", "k", "p", "n")


def per_row(spans: DataFrame, name: str = "spans") -> DataFrame:
    """d, k, and the (p, n) of a row in one array, bounded by the row's text; equal rows bring each span more than once."""
    return spans.groupBy("d", "k").agg(F.collect_set(F.struct("p", "n")).alias(name))


def spans_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays p, n and the offsets of a list<struct<p, n>> column, null as empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def covered(size: int, p: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of `size` units lie in one of the windows p, ..., p + n - 1."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, p, 1)
    np.add.at(change, p + n + window - 1, -1)
    return np.cumsum(change)[:size] > 0
