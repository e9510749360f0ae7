"""Benchmark decontamination: one Aho-Corasick automaton over the normalised item texts scans each document once.

Normalising lower-cases A-Z and keeps words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (digits, a-z and all bytes above ASCII). Item
windows of ten words are the patterns; the automaton runs over the document's words joined by blanks, and hits are mapped
to word numbers, and from there to byte ranges of the original text.

Defined results: a null, empty or wordless text has no words, no hits and is clean; an item without words matches nothing;
an item shorter than the window is one pattern; repeated item ids are one item, repeated documents are judged each for
themselves; an empty benchmark leaves all documents clean. Only the named columns are read, so further columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlweave.llm.staging import fresh, staged

WINDOW = 10
#: Distinct patterns in one automaton, about 300 bytes of memory each and more; a larger benchmark takes several passes.
MAX_PATTERNS = 200_000

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(pattern, items): each distinct window with the ids of the items it occurs in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, patterns = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normal_words(text)
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    ids.append(item)
                    patterns.append(b" ".join(words[i : i + window]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(patterns, pa.binary())], ["item", "pattern"])

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return items.mapInArrow(cut, "item string, pattern binary").groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Scanner:
    """Built once per Python worker from the patterns that came with the function."""

    _built: dict[str, "Scanner"] = {}

    def __init__(self, patterns: list[tuple[bytes, list[str]]]):
        import ahocorasick

        self.items = [items for _, items in patterns]
        self.automaton = ahocorasick.Automaton()
        for k, (pattern, _) in enumerate(patterns):
            # one character per byte; the blanks keep matches on word boundaries
            self.automaton.add_word(f" {pattern.decode('latin-1')} ", (k, pattern.count(b" ") + 1))
        self.automaton.make_automaton()

    @classmethod
    def of(cls, key: str, patterns) -> "Scanner":
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(patterns)
        return cls._built[key]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of words hit, merged and in order, and the items found."""
        if not words or not self.items:
            return [], set()
        line = f" {b' '.join(words).decode('latin-1')} "
        ends, found, ranges = None, set(), []
        for end, (k, size) in self.automaton.iter(line):
            if ends is None:  # word number by the position of the blank behind it
                ends = np.cumsum([len(w) + 1 for w in words])
            last = int(np.searchsorted(ends, end)) + 1
            found.update(self.items[k])
            if ranges and last - size <= ranges[-1][1]:
                low = min(last - size, ranges[-1][0])
                while len(ranges) > 1 and ranges[-2][1] >= low:
                    low = min(low, ranges.pop()[0])
                ranges[-1] = (low, max(last, ranges[-1][1]))
            else:
                ranges.append((last - size, last))
        return ranges, found


_HITS = "struct<n_words:bigint,ranges:array<struct<low:bigint,high:bigint>>,items:array<string>>"


_HITS_TYPE = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _scanning(patterns: list[tuple[bytes, list[str]]]):
    key = hashlib.sha256(repr(patterns).encode()).hexdigest()

    @F.arrow_udf(_HITS)
    def scan(text: pa.Array, before: pa.Array) -> pa.Array:
        scanner = Scanner.of(key, patterns)
        out = []
        for t, past in zip(text, before, strict=True):
            words, past = normal_words(t.as_py()), past.as_py()
            ranges, found = scanner.scan(words)
            ranges += zip(past["low"], past["high"], strict=True)
            out.append({"n_words": len(words), "ranges": [{"low": a, "high": b} for a, b in ranges], "items": sorted(found.union(past["items"]))})
        return pa.array(out, _HITS_TYPE)

    return scan


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_patterns: int = MAX_PATTERNS) -> tuple[DataFrame, str]:
    """docs with one more column (its name is returned too): n_words, ranges of hit words, items found.

    The patterns reach the tasks with the function; their number is measured first. Up to max_patterns it is one
    automaton and one scan. A larger benchmark is cut by hash into automata of that size, which scan in turn, each pass
    a written table, so that neither the driver nor a task ever holds more than one of them.
    """
    spark = docs.sparkSession
    patterns = item_windows(benchmark, window)
    total = patterns.count() if max_patterns else 0
    passes = max(1, -(-total // max_patterns))
    (name,) = fresh(docs, "hits")
    out = docs.withColumn(name, F.expr(f"cast(null as {_HITS})"))
    if passes > 1:
        patterns = staged(patterns, "patterns")
    for k in range(passes):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k)
        rows = sorted((bytes(r.pattern), list(r["items"])) for r in part.collect())
        before = F.struct(*[F.coalesce(F.col(name)[c][f] if f else F.col(name)[c], F.expr(f"cast(array() as array<{t}>)")).alias(f or c) for c, f, t in (("ranges", "low", "bigint"), ("ranges", "high", "bigint"), ("items", "", "string"))])
        out = out.withColumn(name, _scanning(rows)(F.col("text").cast("string"), before))
        if k < passes - 1:
            out = staged(out, "hits")
    return out, name


def hit_words(hits: str):
    """Number of words inside any range (ranges of several passes may overlap)."""
    return F.size(F.array_distinct(F.flatten(F.transform(F.col(hits)["ranges"], lambda r: F.sequence(r["low"], r["high"] - 1))))).cast("bigint")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no item window occurs, with their own columns."""
    out, hits = benchmark_hits(docs, benchmark, window)
    return out.where(F.size(F.col(hits)["ranges"]) == 0).drop(hits)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out, hits = benchmark_hits(docs.select("doc_id", "text"), benchmark, window)
    found = F.col(hits)
    return out.select(
        "doc_id", found["n_words"].alias("n_words"), hit_words(hits).alias("n_hit"), F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found["items"], ",").cast("binary"), 256).alias("items_sha256"), (F.size(found["ranges"]) > 0).alias("contaminated"),
    )


def original_ranges(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges in the UTF-8 text of ranges of words."""
    data = text.encode("utf-8", "surrogatepass").translate(_NORMAL)
    at, spans = 0, []
    for word in data.split():
        start = data.index(word, at)
        at = start + len(word)
        spans.append((start, at))
    return [(spans[a][0], spans[b - 1][1]) for a, b in ranges]
