"""Substring dedup by seed and extend: repeats of 50 words and more that an earlier document holds.

Seeds are winnowed anchors of 16 words. Documents are joined on the anchors that more than one of them has. A match is
extended both ways from the seed, first to the whole stretch of windows that share the anchor: if a document with a smaller
doc_id has the same stretch, all of it repeats. Where an anchor comes with different stretches, the earliest of each is
extended word by word: every 50-word window around the seed is looked up among that anchor's windows. Neighbouring
matches merge, so what goes is the union of maximal repeats of at least 50 words.

No pairs are made: a group of equal stretches is reduced to its smallest doc_id, equal windows likewise, with partial minima
before each shuffle. Equality of stretches and windows is that of two 64-bit hashes (seed and content).

Defined results: null, empty and blank texts have no words; texts below 50 words lose nothing; repeats inside one document
count only if a smaller doc_id has them; rows with the same doc_id don't count against each other; a null doc_id comes after
all others; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlweave.llm.anchors import covered, keyed, per_row, spans_of, split_by_repetition
from crawlweave.llm.hashing import mix, powers, signed, text_runs, words_of

WINDOW, SEED = 50, 16


def word_units(column):
    for texts in text_runs(column):
        words = words_of(texts, lower=False)
        yield texts.first, words.hashes, words.offsets


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): keyed texts; per row (d, k) the windows (p, n) that an earlier document holds."""
    texts = keyed(docs)
    known, unsure = split_by_repetition(texts, word_units, window, seed, across=True)
    rows = texts.join(per_row(unsure), ["d", "k"]).select("d", "k", "text", "spans")

    def extend(batches):
        for batch in batches:
            d, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            p, n, at = spans_of(batch.column(3))
            for first, hashes, offsets in word_units(batch.column(2)):
                up, down = powers(len(hashes) + 1)
                sums = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
                own = slice(at[first], at[first + len(offsets) - 1])
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(at[first : first + len(offsets)]))
                row, start, count = np.repeat(row, n[own]), np.repeat(p[own], n[own]), n[own].astype(np.int64)
                place = start + np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
                x = place + offsets[row]
                whole = (sums[x + window] - sums[x]) * down[x]
                w1, w2 = mix(whole), mix(whole ^ hashes[x])
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (signed(w1), signed(w2), d[row + first], k[row + first], place.astype(np.int32))], ["w1", "w2", "d", "k", "p"])

    looked = rows.mapInArrow(extend, "w1 bigint, w2 bigint, d bigint, k bigint, p int")
    least = looked.groupBy("w1", "w2").agg(F.min("d").alias("d1"), F.max("d").alias("d2")).where("d1 < d2").drop("d2")
    late = looked.join(least, ["w1", "w2"]).where("d > d1").select("d", "k", "p", F.lit(1).alias("n"))
    return texts, per_row(known.unionByName(late))


def _cut(window: int):
    def cut(batches):
        for batch in batches:
            p, n, at = spans_of(batch.column(2))
            out = [[], [], [], []]
            for texts in text_runs(batch.column(1)):
                words = words_of(texts, lower=False)
                raw = texts.data.tobytes()
                for r in range(texts.rows):
                    low, high = words.offsets[r], words.offsets[r + 1]
                    own = slice(at[texts.first + r], at[texts.first + r + 1])
                    gone = covered(int(high - low), p[own], n[own], window)
                    if own.start == own.stop:
                        kept = raw[texts.offsets[r] : texts.offsets[r + 1]].split()
                    else:
                        stay = np.flatnonzero(~gone) + low
                        kept = [raw[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]
                    out[0].append(int(high - low))
                    out[1].append(int(gone.sum()))
                    out[2].append(b" ".join(kept).decode("utf-8", "replace"))
                    out[3].append(int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["doc_id", "n_words", "n_removed", "kept", "n_spans"])

    return cut


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, joined by blanks), n_spans (maximal runs removed)."""
    texts, spans = repeats(docs, window, seed)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.join(spans, ["d", "k"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut(window), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, n_spans bigint")


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_spans."""
    df = without_repeats(docs)
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "n_spans")
