"""Byte-level dedup over a run-length index: what repeats an earlier 100-byte string goes.

Which stretches of text can repeat is found by winnowed anchors (see anchors.py): of each distinct stretch all but the earliest
occurrence repeats whole, a text's phrases being indexed once however often they occur, as prefix-free parsing does for large
repetitive collections (Boucher et al., Algorithms Mol. Biol. 2019). Different stretches around one anchor - the edges of
near copies and of shared passages - go into run-length indexes, one per task and batch of anchors:

* `RunIndex` sorts the suffixes of the batch by 99 bytes and builds the Burrows-Wheeler transform in that order, rows of one
  99-byte context together and, inside it, by the byte before. It keeps one entry per run: context, byte, length, and the
  text position sampled at the run's first end, which is the earliest one, together with the context that the step
  by that byte leads to.
* The stretches are streamed through it from right to left, all at once: with the context of the last 99 bytes, each byte
  finds its run by binary search. That is the matching statistic capped at 100: the run is the set of all occurrences of
  byte + context, its sample the earliest of them. A window whose earliest occurrence lies before its own place is marked.

An anchor with more different stretches than `SPLIT` is cut by a hash of the stretch over several indexes; these also report
their runs' samples, and the earliest sample of each window over the indexes decides.

Defined results: null and empty texts have no bytes; texts below 100 bytes lose nothing; order is doc_id (null last), then for
equal ids a hash of the row, then the place in the text; equal rows with one id are one document; an empty table gives
an empty result. Only doc_id and text are read. Equality of distinct stretches is that of two 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlweave.llm.anchors import covered, keyed, per_row, spans_of, split_by_repetition
from crawlweave.llm.hashing import WORD_TABLE, mix, powers, signed, text_runs
from crawlweave.llm.staging import staged

WINDOW, SEED = 100, 32
#: Bytes indexed at a time, and stretches of one anchor that stay in one index.
BATCH, SPLIT = 1 << 20, 2_000
_U = np.uint64


def byte_units(column):
    for texts in text_runs(column, 1 << 18):
        yield texts.first, WORD_TABLE[texts.data], texts.offsets


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(_U)


def context_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each position by the `depth` bytes from there, zeros behind the end: doubling from 8 bytes on."""
    n = len(data)
    shifted = lambda x, by: np.concatenate([x[by:], np.zeros(min(by, n), x.dtype)])[:n]
    packed = np.zeros(n, _U)
    for i in range(8):
        packed = (packed << _U(8)) | shifted(data.astype(_U), i)
    ranks, known = {8: _ranks(packed)}, 8
    while known * 2 <= depth:
        ranks[known * 2] = _ranks((ranks[known] << _U(32)) | shifted(ranks[known], known))
        known *= 2
    total, whole = ranks[known], known
    for size in sorted(ranks, reverse=True):
        while whole + size <= depth:
            total, whole = _ranks((total << _U(32)) | shifted(ranks[size], whole)), whole + size
    tail = np.zeros(n, _U)
    for i in range(whole, depth):  # fewer than eight bytes are left
        tail = (tail << _U(8)) | shifted(data.astype(_U), i)
    if whole < depth:
        total = _ranks((total << _U(32)) | _ranks(tail))
    return total.astype(np.int64)


class RunIndex:
    """Run-length Burrows-Wheeler transform of `data` in the order of window - 1 bytes, with samples at run ends.

    data holds stretches in order of their places, each followed by a zero byte and starting at `starts`; no window crosses
    from one to the next.
    """

    def __init__(self, data: np.ndarray, window: int = WINDOW):
        self.window = window
        self.context = context_ranks(data, window - 1)
        before = np.zeros(len(data), np.int64)
        before[1:] = data[:-1]
        keys = self.context * 256 + before
        order = np.argsort(keys, kind="stable")  # the suffix array; equal keys by place
        keys = keys[order]
        ends = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys = keys[ends]  # context and byte of each run
        self.lengths = np.diff(np.append(ends, len(keys)))
        self.samples = order[ends]  # first end of the run: the earliest suffix after that byte
        self.next = self.context[np.maximum(self.samples - 1, 0)]

    def earliest(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Stream the stretches right to left: (place of each window, its earliest occurrence)."""
        at = starts + sizes - (self.window - 1)
        state = self.context[at]
        places, found = [], []
        alive = np.arange(len(starts))
        while True:
            alive = alive[at[alive] > starts[alive]]
            if not len(alive):
                break
            run = np.searchsorted(self.keys, state[alive] * 256 + data[at[alive] - 1])
            at[alive] -= 1
            state[alive] = self.next[run]
            places.append(at[alive])
            found.append(self.samples[run] - 1)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return join(places), join(found)


_OUT = "d bigint, k bigint, p int, w1 bigint, w2 bigint"
_FIELDS = ["d", "k", "p", "w1", "w2"]


def _window_hashes(data: np.ndarray, places: np.ndarray, window: int):
    values = WORD_TABLE[data]
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(values * powers(len(data))[0], out=sums[1:])
    whole = (sums[places + window] - sums[places]) * powers(len(data) + 1)[1][places]
    return mix(whole), mix(whole ^ mix(values[places] + data[places + window // 2].astype(_U)))


def _mark_batch(rows: list, window: int):
    """Marks (w1 null) of a batch of stretches (cut, d, k, p, bytes); for those of split anchors the samples too."""
    rows.sort(key=lambda r: r[1:4])
    sizes = np.array([len(r[4]) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    data = np.frombuffer(b"\0".join(r[4] for r in rows) + b"\0", np.uint8)
    places, first = RunIndex(data, window).earliest(data, starts, sizes)
    own = np.searchsorted(starts, places, "right") - 1
    d, k, p = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
    cut = np.array([r[0] for r in rows], bool)
    marked = first < places
    sample = cut[own] & ~marked
    w1, w2 = _window_hashes(data, places[sample], window)
    chosen = np.concatenate([np.flatnonzero(marked), np.flatnonzero(sample)])
    none = pa.nulls(int(marked.sum()), pa.int64())
    at = own[chosen]
    columns = [pa.array(d[at]), pa.array(k[at]), pa.array((p[at] + places[chosen] - starts[at]).astype(np.int32))]
    hashes = [pa.concat_arrays([none, pa.array(signed(w))]) for w in (w1, w2)]
    return pa.RecordBatch.from_arrays([*columns, *hashes], _FIELDS)


def _index(window: int):
    def index(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for h, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH and h != last:
                    yield _mark_batch(held, window)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = h
        if held:
            yield _mark_batch(held, window)

    return index


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): keyed texts; per row (d, k) the windows (p, n) that occur earlier."""
    texts = keyed(docs)
    known, unsure = split_by_repetition(texts, byte_units, window, seed, across=False)
    parts = unsure.groupBy("h").agg(F.ceil(F.count("*") / split).alias("parts"))
    unsure = unsure.join(parts, "h").withColumn("part", F.pmod(F.xxhash64("d", "k", "p"), F.col("parts")).cast("int"))
    spans = unsure.groupBy("d", "k").agg(F.collect_set(F.struct("p", "n", "h", "part", "parts")).alias("spans"))
    # equal rows are one document: a second copy's stretches would be taken for later occurrences of the first one's
    rows = texts.select("d", "k", F.col("text").cast("binary").alias("b")).dropDuplicates(["d", "k"]).join(spans, ["d", "k"])
    each = rows.select("d", "k", "b", F.explode("spans").alias("s"))
    cut = F.substring("b", F.col("s.p") + 1, F.col("s.n") + window - 1)
    each = each.select(F.col("s.h").alias("h"), F.col("s.part").alias("part"), (F.col("s.parts") > 1).alias("cut"), "d", "k", F.col("s.p").alias("p"), cut.alias("bytes"))
    dealt = each.repartition("h", "part").sortWithinPartitions("h", "part")
    marks = staged(dealt.select("h", "cut", "d", "k", "p", "bytes").mapInArrow(_index(window), _OUT), "marks")
    samples = marks.where("w1 is not null")
    least = samples.groupBy("w1", "w2").agg(F.min(F.struct("d", "k", "p")).alias("least"), F.count("*").alias("m")).where("m > 1")
    late = samples.join(least, ["w1", "w2"]).where(F.struct("d", "k", "p") > F.col("least"))
    late = marks.where("w1 is null").select("d", "k", "p").unionByName(late.select("d", "k", "p")).withColumn("n", F.lit(1))
    return texts, per_row(known.unionByName(late))


def _cut(window: int):
    def cut(batches):
        for batch in batches:
            p, n, at = spans_of(batch.column(2))
            out = [[], [], [], []]
            for texts in text_runs(batch.column(1)):
                for r in range(texts.rows):
                    data = texts.data[texts.offsets[r] : texts.offsets[r + 1]]
                    own = slice(at[texts.first + r], at[texts.first + r + 1])
                    gone = covered(len(data), p[own], n[own], window)
                    out[0].append(len(data))
                    out[1].append(int(gone.sum()))
                    out[2].append(data[~gone].tobytes())
                    out[3].append(int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[2], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; characters may be cut in two)."""
    texts, spans = repeats(docs, window, seed)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.join(spans, ["d", "k"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut(window), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    df = without_repeats(docs)
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
