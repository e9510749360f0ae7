"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

Documents are reduced once to what the items ask for: the number of terms, and the item terms with their frequencies, written as
a table. Document frequencies, N and L are grouped sums over it. Then each task turns the rows it reads into segments of an
inverted index, documents in order of doc_id, and answers all items on each segment:

* The item's short lists (those of few documents of the segment) are taken term at a time into summed accumulators.
* The accumulators are one more list, bounded by their largest sum. It and the long lists are sorted by bound and walked document
  at a time, a block of documents in one step: lists whose bounds together can't lift a document over the threshold no longer
  name candidates, but are skipped through, looked up at the candidates that their remaining bound leaves.

Only a segment's best documents for each item are shuffled. Items are answered in passes of at most about `max_terms` item terms,
so what reaches the tasks has a fixed bound; documents are never collected or dealt by term, so a very frequent term is no hot key.

Defined results: rows of one item_id are one item with the terms of its distinct texts (null is an item_id too); a null or
termless item or document matches nothing; repeated documents rank each for themselves; equal scores go by ascending doc_id,
null last; with no terms at all the result is empty. Long texts are read a piece at a time. Only item_id, doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from crawlweave.llm.hashing import in_slices
from crawlweave.llm.pieces import word_pieces
from crawlweave.llm.staging import staged

TOP = 20
#: Item terms (item and term) answered in one pass.
MAX_TERMS = 200_000
#: A segment of the index ends beyond so many documents or postings.
SEGMENT_ROWS, SEGMENT_POSTINGS = 1 << 15, 4_000_000
#: Lists of at most this share of a segment's documents are short.
SHORT = 1 / 16
#: Documents in one step.
BLOCK = 2048

_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_pieces(text: bytes | None) -> Iterator[list[bytes]]:
    return word_pieces((text or b"").translate(_TERMS))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): the terms of each item and how often it has them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, terms, counts = [], [], []
            for row, text in enumerate(batch.column(1)):
                found: Counter = Counter()
                for words in term_pieces(text.as_py()):
                    found.update(words)
                ids += [row] * len(found)
                terms += found.keys()
                counts += found.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())], ["item_id", "term", "n"])

    kind = items.schema["item_id"].dataType.simpleString()
    texts = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).distinct()
    return texts.mapInArrow(cut, f"item_id {kind}, term binary, n bigint").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def document_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): terms of a document, and those of the vocabulary with how often they occur."""
    numbers = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value.get
        for batch in in_slices(batches):
            sizes, terms, tfs = [], [], []
            for text in batch.column(1):
                n, found = 0, Counter()
                for words in term_pieces(text.as_py()):
                    n += len(words)
                    found.update(map(known, words))
                found.pop(None, None)
                sizes.append(n)
                terms.append(list(found))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(cut, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


class Segment:
    """An inverted index over some documents: lists by term, documents in order of doc_id, what each posting adds per weight."""

    def __init__(self, rows: pa.Table, documents: int, all_terms: int):
        rows = rows.take(pc.array_sort_indices(rows.column("doc_id"), null_placement="at_end")).combine_chunks()
        self.ids, self.size = rows.column("doc_id"), rows.num_rows
        n = rows.column("n").to_numpy()
        if self.size and 25 * int(n.max()) * documents >= 1 << 63:
            m = np.array([75 + 25 * int(x) * documents // all_terms for x in n], np.int64)
        else:
            m = 75 + 25 * n * documents // max(1, all_terms)
        lengths = pc.list_value_length(rows.column("terms")).to_numpy()
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy() if self.size else np.empty(0, np.int64)
        term, tf, doc = flat("terms"), flat("tfs"), np.repeat(np.arange(self.size), lengths)
        order = np.argsort(term, kind="stable")  # documents stay in order within a term
        term, tf, self.docs = term[order], tf[order], doc[order]
        self.adds = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.docs])
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(term))[: len(starts)]
        best = np.maximum.reduceat(self.adds, starts) if len(term) else starts
        self.lists = {t: x for t, *x in zip(term[starts].tolist(), starts.tolist(), ends.tolist(), best.tolist(), strict=True)}

    def search(self, query: list[tuple[int, int]], top: int = TOP, short: float = SHORT, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the best documents for (term, weight) pairs, best first."""
        longs, parts = [], []
        for term, weight in query:
            if weight > 0 and term in self.lists:
                a, b, best = self.lists[term]
                if b - a <= short * self.size:
                    parts.append((self.docs[a:b], weight * self.adds[a:b]))
                else:
                    longs.append((weight * best, self.docs[a:b], self.adds[a:b], weight))
        if parts:  # term at a time
            docs, where = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
            sums = np.zeros(len(docs), np.int64)
            np.add.at(sums, where, np.concatenate([s for _, s in parts]))
            longs.append((int(sums.max()), docs, sums, 1))
        longs.sort(key=lambda x: x[0])
        reach = np.cumsum([x[0] for x in longs])  # of this list and all with smaller bounds
        places, scores, least, at = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
        while at < self.size:
            first = int(np.searchsorted(reach, least, "right"))  # the lists before can't lift a document over the threshold
            if first == len(longs):
                break
            end = min(self.size, at + block)
            sums = np.zeros(end - at, np.int64)
            for _, docs, adds, weight in longs[first:]:
                a, b = np.searchsorted(docs, (at, end))
                sums[docs[a:b] - at] += weight * adds[a:b]
            rest = int(reach[first - 1]) if first else 0
            found = np.flatnonzero((sums > 0) & (sums + rest > least))
            sums, found = sums[found], found + at
            for bound, docs, adds, weight in reversed(longs[:first]):
                if not len(found):
                    break
                to = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                sums = sums + np.where(docs[to] == found, weight * adds[to], 0)
                rest -= bound
                stay = sums + rest > least
                sums, found = sums[stay], found[stay]
            if len(found):  # later documents lose ties, so only higher scores come in
                places, scores = np.concatenate([places, found]), np.concatenate([scores, sums])
                order = np.lexsort((places, -scores))[:top]
                places, scores = places[order], scores[order]
                least = int(scores[-1]) if len(scores) == top else 0
            at = end
        return places, scores


def _searching(ids: pa.Array, queries, documents: int, all_terms: int, top: int):
    """A function of batches of document_terms() -> (item_id, doc_id, score): the best of each segment for each of the items `ids`."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            segment = Segment(pa.Table.from_batches(held), documents, all_terms)
            found = [segment.search(query, top) for query in queries.value]
            item = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
            places, scores = (np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(item)), segment.ids.take(pa.array(places)).combine_chunks(), pa.array(scores)], ["item_id", "doc_id", "score"])

        held, rows, postings = [], 0, 0
        for batch in in_slices(batches, 4096):
            held.append(batch)
            rows += batch.num_rows
            postings += len(batch.column(2).flatten())
            if rows >= SEGMENT_ROWS or postings >= SEGMENT_POSTINGS:
                yield answers(held)
                held, rows, postings = [], 0, 0
        if held:
            yield answers(held)

    return search


def weight(documents: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * with_term + 1)))


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, max_terms: int = MAX_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    asked = staged(item_terms(items), "asked")
    passes = max(1, -(-asked.count() // max_terms))
    best, held = [], to_arrow_type(items.schema["item_id"].dataType)
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    for k in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        index = staged(document_terms(docs, vocabulary), "terms")
        totals = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        holding = {r["t"]: r["n"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
        by_item: dict = {}
        for r in rows:
            t = vocabulary[bytes(r["term"])]
            if t in holding:
                by_item.setdefault(r["item_id"], []).append((t, r["n"] * weight(totals["documents"], holding[t])))
        queries = spark.sparkContext.broadcast(list(by_item.values()))
        search = _searching(pa.array(list(by_item), held), queries, totals["documents"], totals["terms"], top)
        best.append(index.mapInArrow(search, f"{', '.join(kinds)}, score bigint"))
    found = best[0]
    for more in best[1:]:
        found = found.unionByName(more)
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
