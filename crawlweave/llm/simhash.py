"""SimHash near-dedup by meet-in-the-middle ball hashing: texts whose fingerprints differ in three bits or fewer are linked.

A fingerprint has 64 bits: bit b is set where over half of the text's shingle hashes (XXH64, seed 42) have it. Every distinct
fingerprint emits all variants within half the radius, that is one flipped bit:

* Two fingerprints that share a variant are within two bits, whatever the variant, so the fingerprints of a variant are
  linked to its smallest one, with nothing left to verify, and their components are found.
* The third bit of the radius is odd. It lies in one of four blocks of sixteen bits, so the variants meet once more with each
  block in turn left out of the key. Candidates of one key are verified by the block's bits: the variants are told apart by
  them, and two variants one bit apart link their fingerprints, as then at most one flip lies on each side and one between. A
  pair whose three bits all lie in the block left out has equal bits outside, so variants with a flip inside the block join in.

Only fingerprints of different components are candidates in the second step, and all fingerprints of one variant belong to one
component by then, so it moves one row for each variant. No pairs within a group are listed, and nothing is capped.

Defined results: a text without words (null, empty) has fingerprint zero, which links like any other; fewer words than a
shingle are one shingle; equal rows are linked; a component of null doc_ids only has component_id null, otherwise nulls don't
count; an empty table gives an empty result. Very long texts are hashed a piece at a time. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from crawlweave.llm.components import components
from crawlweave.llm.hashing import in_slices
from crawlweave.llm.pieces import word_pieces
from crawlweave.llm.staging import staged

SHINGLE = 3
SEED = 42
BITS = 64
#: Bits of a block that is left out; 64 / 16 blocks.
BLOCK = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The bits of each byte, highest first.
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def shingle_hashes(text: bytes | None, size: int = SHINGLE, piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 of each shingle as eight bytes, highest first, for a piece of the text at a time."""
    import xxhash

    digest, before, any_yet = xxhash.xxh64_digest, [], False
    for words in word_pieces((text or b"").translate(_LOWER), piece):
        words = before + words
        if len(words) < size:
            before = words
            continue
        line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
        held = b"".join([digest(line[s : e - 1], SEED) for s, e in zip(chain((0,), ends), ends[size - 1 :], strict=False)])
        yield np.frombuffer(held, np.uint8).reshape(-1, 8)
        before, any_yet = words[len(words) - size + 1 :], True
    if before and not any_yet:
        yield np.frombuffer(digest(b" ".join(before), SEED), np.uint8).reshape(-1, 8)


class _Votes:
    """Set bits of the hashes of some rows, counted by byte values."""

    def __init__(self, rows: int, hold: int = 1 << 17):
        self.set, self.n = np.zeros((rows, BITS)), np.zeros(rows, np.int64)
        self.hold, self.waiting, self.of, self.size = hold, [], [], 0

    def add(self, row: int, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.of.append(row)
        self.size += len(hashes)
        if self.size > self.hold:
            self.count()

    def count(self) -> None:
        if self.waiting:
            kinds = {r: i for i, r in enumerate(dict.fromkeys(self.of))}
            sizes = [len(h) for h in self.waiting]
            rows = np.repeat([kinds[r] for r in self.of], sizes)
            place = (rows[:, None] * 8 + np.arange(8)) * 256 + np.concatenate(self.waiting)
            counts = np.bincount(place.ravel(), minlength=len(kinds) * 2048).reshape(-1, 256)
            self.set[list(kinds)] += (counts.astype(np.float64) @ _BITS_OF_BYTE).reshape(-1, BITS)
            np.add.at(self.n, self.of, sizes)
        self.waiting, self.of, self.size = [], [], 0

    def fingerprints(self) -> np.ndarray:
        self.count()
        over_half = 2 * self.set > self.n[:, None]
        return np.packbits(over_half, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text as bytes) -> (doc_id, fp), a few rows at a time."""
    for batch in in_slices(batches, 64):
        votes = _Votes(batch.num_rows)
        for row, text in enumerate(batch.column(1)):
            for hashes in shingle_hashes(text.as_py()):
                votes.add(row, hashes)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes.fingerprints())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's text as a signed 64-bit number."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp bigint")


def links_within_two(fps: DataFrame) -> DataFrame:
    """Edges (a, b) from each distinct fingerprint to the smallest one of each variant it shares."""
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("k"))
    flipped = F.when(F.col("k") < BITS, F.expr("fp ^ shiftleft(1L, k)")).otherwise(F.col("fp"))
    least = F.min("fp").over(Window.partitionBy("v"))
    met = variants.select("fp", flipped.alias("v")).withColumn("least", least)
    return met.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def links_at_three(labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the labels of fingerprints (fp, label) three bits apart; closer ones have one label already."""
    outside, blocks, full = BITS - block, BITS // block, (1 << block) - 1
    cut = labelled.select("fp", "label", F.explode(F.sequence(F.lit(0), F.lit(blocks * (outside + 1) - 1))).alias("k"))
    cut = cut.select("fp", "label", F.expr(f"k div {outside + 1}").cast("int").alias("j"), (F.col("k") % (outside + 1)).alias("i"))
    cut = cut.withColumn("flip", F.expr(f"case when i = {outside} then 0L when i < {block} * j then shiftleft(1L, i) else shiftleft(1L, i + {block}) end"))
    cut = cut.select("j", F.expr(f"(fp ^ flip) & ~shiftleft({full}L, {block} * j)").alias("v"), "fp", "label")
    key = Window.partitionBy("j", "v")
    cut = cut.withColumn("low", F.min("label").over(key)).withColumn("high", F.max("label").over(key)).where("low <> high").drop("low", "high")
    inside = F.expr(f"cast(shiftrightunsigned(fp, {block} * j) & {full}L as int)")
    whole = F.expr(f"(fp & ~shiftleft({full}L, {block} * j)) = v")
    flips = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda b: F.call_function("shiftleft", F.lit(1), b).bitwiseXOR(F.col("w")))
    nodes = cut.withColumn("w", inside).select("j", "v", "label", F.explode(F.when(whole, F.concat(F.array("w"), flips)).otherwise(F.array("w"))).alias("w"))
    nodes = staged(nodes.groupBy("j", "v", "w").agg(F.min("label").alias("a")), "variants")  # one label each
    higher = F.filter(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda b: F.call_function("shiftleft", F.lit(1), b).bitwiseOR(F.col("w"))), lambda x: x != F.col("w"))
    up = nodes.select("j", "v", F.explode(higher).alias("w"), F.col("a").alias("b"))
    met = nodes.join(up, ["j", "v", "w"]).where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, root) for every distinct fingerprint of `fps`: its component by links at three or fewer differing bits."""
    fps = fps.select("fp").distinct()
    close = components(links_within_two(fps)).select(F.col("node").alias("fp"), "root")
    labelled = staged(fps.join(close, "fp", "left").select("fp", F.coalesce("root", "fp").alias("label")), "labels")
    far = components(links_at_three(labelled)).select(F.col("node").alias("label"), "root")
    return labelled.join(far, "label", "left").select("fp", F.coalesce("root", "label").alias("root"))


def component_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    rows = staged(fingerprints(docs), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = staged(least.join(fingerprint_components(rows), "fp"), "roots")
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame) -> DataFrame:
    """(doc_id) of the document that stays of each component: the one with the smallest doc_id."""
    return component_report(docs).groupBy("component_id").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
