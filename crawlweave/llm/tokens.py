"""Cross-tokenizer alignment: where the tokens of a byte-level BPE (A) and of a piece tokenizer (B) end at the same bytes.

The spans that the tokenizers report are the coarse cuts: character offsets of A, byte offsets of B. A token that ends inside a
character (its span overlaps the next one's) or is a byte fallback (its span is empty) is refined with the decoded bytes of its
entry: lengths are added up from the last clean cut. The decoded bytes of all tokens must be the text's own, or it has none.

A text is a blank and then its units: runs between blanks that stand between two characters other than white space. Neither
kind of tokenizer joins anything across such a cut, which is read from their files (A splits words by its own pattern, no piece
of B has a blank behind another character) and asserted for each run of units; where it doesn't hold a whole text is one unit.
So units met before are taken from a bounded cache, and the others of a batch are tokenized together in one run, but for those
with white space at an end of their text, which are tokenized alone.

Three steps: texts are aligned and written with their distinct id pairs; pairs are counted over all documents by a grouped sum;
the counts are looked up. The look-up table is sent to the tasks in passes of at most `max_pairs` pairs, so its size is bounded
whatever the corpus; the rows that it is met with stay where they are.

Defined results: null and empty texts, and those whose joined bytes differ from a blank and the text, have no tokens: zeros, no
groups; equal rows count as documents of their own; texts may be of any length and are read in pieces cut between units; an
empty table gives an empty result. Only doc_id and text are read. The files' paths are parameters.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from crawlweave.llm.hashing import in_slices
from crawlweave.llm.staging import staged

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Units of a worker's cache, in two halves: the older half goes when the newer is full.
CACHE = 480_000
#: Units longer than this are not kept.
LONGEST_KEPT = 64
#: Characters tokenized in one run, and of a text in one piece.
RUN = 1 << 18
#: Id pairs looked up in one pass, 17 bytes each.
MAX_PAIRS = 4_000_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACES = tuple(c for c in map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def byte_level_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if printable, else the next one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _refined(coarse: np.ndarray, clean: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ends of tokens: the coarse one where it is clean, else the lengths added up from the last clean one."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    last = np.maximum.accumulate(np.where(clean, np.arange(1, len(clean) + 1), 0))
    base = np.concatenate([[0], coarse])[last]
    return base + total[1:] - total[last]


class Aligner:
    """Both tokenizers with the bytes of their entries, and the units met before."""

    def __init__(self, byte_bpe: str, pieces: str, ends: bool = True):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.a = tokenizers.Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet, vocabulary = byte_level_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        with open(byte_bpe, encoding="utf-8") as f:
            steps = json.load(f).get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers") or [steps]
        by_words = any(s.get("type") == "ByteLevel" and s.get("use_regex", True) for s in steps)
        self.cuts = by_words and not any(re.search("[^▁]▁", p) for p in names)
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.names = [f"{i}{behind}" for i in range(most) for behind in ",|;"]
        self.widths = np.array([len(str(i)) + 1 for i in range(most)], np.int64)
        self.ends = ends
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def spans(self, run: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and ends (bytes) by A and by B of a run that begins with a blank; None if the joined bytes are others."""
        data = run.encode("utf-8", "surrogatepass")
        coded, pieces = self.a.encode(run, add_special_tokens=False), self.b.encode(run[1:], return_type="offset_mapping", return_bytes=True)
        a, b = coded.ids, pieces["ids"]
        if b"".join(map(self.bytes_a.__getitem__, a)) != data or b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        spans = np.fromiter(chain.from_iterable(coded.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # of characters
        at = np.concatenate([begins, [len(data)]])
        clean = np.concatenate([spans[1:, 0] >= spans[:-1, 1], [True]])
        ends_a = _refined(at[spans[:, 1]], clean, self.length_a[a])
        spans = np.fromiter(chain.from_iterable(pieces["offsets"]), np.int64, 2 * len(b)).reshape(-1, 2)
        clean = (spans[:, 1] > spans[:, 0]) & np.concatenate([spans[1:, 1] > spans[:-1, 1], [True]])
        clean &= np.concatenate([spans[1:, 0] >= spans[:-1, 1], [True]])
        ends_b = _refined(spans[:, 1] + 1, clean, self.length_b[b])
        return a, ends_a, b, ends_b

    def _aligned_run(self, units: list[str], into: dict[str, tuple | None]) -> None:
        """Results of units, tokenized as one run; halves of it if the bytes differ somewhere."""
        run = " " + " ".join(units)
        found = self.spans(run)
        if found is None:
            if len(units) == 1:
                into[units[0]] = None
            else:
                for half in (units[: len(units) // 2], units[len(units) // 2 :]):
                    self._aligned_run(half, into)
            return
        a, ends_a, b, ends_b = found
        # each stretch between two neighbouring ends lies in one token of either side: one link
        links = np.unique(np.concatenate([ends_a, ends_b]))
        pairs = (a[np.searchsorted(ends_a, links)] << 32) | b[np.searchsorted(ends_b, links)]
        cuts = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        unit_ends = np.cumsum([len(u) + 1 if u.isascii() else len(u.encode("utf-8", "surrogatepass")) + 1 for u in units])
        last = np.searchsorted(cuts, unit_ends)
        if not np.array_equal(cuts[np.minimum(last, len(cuts) - 1)], unit_ends):
            raise ValueError("a token crosses a cut between units")
        # A's tokens of a group, then B's, each written with what stands behind it
        of_a, of_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        behind = np.concatenate([np.append(of_a[1:] != of_a[:-1], True).astype(np.int64), 2 * np.append(of_b[1:] != of_b[:-1], True)])
        written = (3 * np.concatenate([a, b]) + behind)[order]
        line = "".join([self.names[k] for k in written.tolist()])
        to_a, to_b = np.searchsorted(ends_a, unit_ends, "right"), np.searchsorted(ends_b, unit_ends, "right")
        sums = np.diff(to_a, prepend=0) | np.diff(to_b, prepend=0) << 21 | np.diff(last, prepend=-1) << 42
        to_line = np.cumsum(self.widths[written // 3])[to_a + to_b - 1]
        to_link = 8 * np.searchsorted(links, unit_ends, "right")
        held, low = pairs.tobytes(), (cuts - np.repeat(unit_ends - np.diff(unit_ends, prepend=0), np.diff(last, prepend=-1))).tobytes() if self.ends else b""
        c = k = g = start = 0
        for unit, c2, n, k2, g2, end in zip(units, to_line.tolist(), sums.tolist(), to_link.tolist(), (8 * (last + 1)).tolist(), unit_ends.tolist(), strict=True):
            into[unit] = (line[c : c2 - 1], n, held[k:k2], end - start, low[g:g2])
            c, k, g, start = c2, k2, g2, end

    def units(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        beside = any(c in text and (c + " " in text or " " + c in text) for c in _SPACES) or text[:1] == " " or text[-1:] == " "
        return _CUT.split(text) if beside else text.split(" ")

    def known(self, wanted: list[list[str]]) -> dict[str, tuple | None]:
        """Sees to it that all units of some texts are in the newer half of the cache; the long ones are returned instead."""
        if len(self.young) > CACHE // 2:
            self.old, self.young = self.young, {}
        young, old, more = self.young, self.old, {}
        run, size = [], 0
        for u in {u for units in wanted for u in units if u not in young}:
            found = old.get(u, 0)
            if found != 0:
                young[u] = found
                continue
            if len(u.strip()) < len(u):
                # at an end of its text; beside others the blank between them would be joined to its white space
                self._aligned_run([u], more)
                continue
            run.append(u)
            size += len(u) + 1
            if size > RUN or not self.cuts:
                self._aligned_run(run, more)
                run, size = [], 0
        if run:
            self._aligned_run(run, more)
        long = {u: r for u, r in more.items() if len(u) > LONGEST_KEPT}
        young.update({u: r for u, r in more.items() if len(u) <= LONGEST_KEPT} if long else more)
        return long

    def texts(self, texts: list[str | None]) -> list[tuple | None]:
        """For each text: n_a, n_b, n_groups, n_links, sha256, distinct pairs, how often each, groups, group ends (the last two if asked)."""
        out: list[tuple | None] = []
        for at in range(0, len(texts), 128):
            some = texts[at : at + 128]
            short = [self.units(t) if t and len(t) <= RUN else [] for t in some]
            long = self.known(short)
            for text, units in zip(some, short, strict=True):
                if not text:
                    out.append(None)
                elif units:
                    out.append(self._text([units], [long]))
                else:
                    pieces = [self.units(p) for p in self._pieces(text)]
                    out.append(self._text(pieces, (self.known([p]) for p in pieces)))
        return out

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while self.cuts and len(text) - at > RUN and (cut := _CUT.search(text, at + RUN)):
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:]

    def _text(self, pieces, results) -> tuple | None:
        digest, groups, cuts, sums, base, first = hashlib.sha256(), [], [], [0, 0, 0, 0], 0, True
        pairs, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for units, long in zip(pieces, results, strict=True):
            young = self.young
            found = [young[u] if u in young else long[u] for u in units] if long else [young[u] for u in units]
            if None in found:
                return None
            line = ";".join([r[0] for r in found])
            digest.update(line.encode() if first else b";" + line.encode())
            first = False
            packed = sum([r[1] for r in found])
            linked = np.frombuffer(b"".join([r[2] for r in found]), np.int64)
            for k, n in enumerate((packed & 0x1FFFFF, packed >> 21 & 0x1FFFFF, packed >> 42, len(linked))):
                sums[k] += n
            linked = np.sort(linked)
            starts = np.flatnonzero(np.concatenate([[True], linked[1:] != linked[:-1]]))
            new, n = linked[starts], np.diff(starts, append=len(linked))
            if len(pairs):
                pairs, where = np.unique(np.concatenate([pairs, new]), return_inverse=True)
                times = np.bincount(where, np.concatenate([times, n])).astype(np.int64)
            else:
                pairs, times = new, n
            if self.ends:
                groups.append(line)
                for r in found:
                    cuts.append(np.frombuffer(r[4], np.int64) + base)
                    base += r[3]
        return (*sums, digest.hexdigest(), pairs, times, ";".join(groups), np.concatenate(cuts) if cuts else None)


@lru_cache(maxsize=1)
def _aligner(byte_bpe: str, pieces: str, ends: bool) -> Aligner:
    return Aligner(byte_bpe, pieces, ends)


def alignments(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, groups: bool = True) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (A id * 2**32 + B id, distinct), times, and with
    `groups` the groups themselves (`a1,a2|b1;a3|b2`) and the byte of the blank and the text at which each ends."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
    schema += ", groups string, group_ends array<bigint>" if groups else ""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, none = _aligner(byte_bpe, pieces, groups), np.empty(0, np.int64)
        for batch in in_slices(batches):
            gc.disable()  # millions of small tuples without cycles
            try:
                rows = [r or (0, 0, 0, 0, "", none, none, "", none) for r in aligner.texts(batch.column(1).to_pylist())]
            finally:
                gc.enable()
            lists = lambda k, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r[k]) for r in rows])]).astype(np.int32)), pa.array(np.concatenate([none, *(r[k] for r in rows)]).astype(kind)))
            columns = [batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array([r[4] for r in rows], pa.string()), lists(5, np.int64), lists(6, np.int32)]
            if groups:
                columns += [pa.array([r[7] for r in rows], pa.string()), lists(8, np.int64)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(align, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best) for every linked id pair: the documents that hold it, and whether no pair of its A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftrightunsigned("pair", 32)))
    return counts.select("pair", "docs", (F.col("docs") == most).alias("best"))


def _looked_up(table) -> object:
    @F.arrow_udf("struct<best:bigint,docs:bigint>")
    def look_up(pairs: pa.Array, times: pa.Array) -> pa.Array:
        known, docs, best = table.value
        flat, n = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        n = np.where(known[at] == flat, n, 0)
        ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))])
        of = lambda values: pa.array(np.diff(np.concatenate([[0], np.cumsum(values)])[ends]))
        return pa.StructArray.from_arrays([of(n * best[at]), of(n * docs[at])], ["best", "docs"])

    return look_up


def with_counts(aligned: DataFrame, counts: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """aligned with n_best and count_sum, looked up in passes over at most about max_pairs pairs of `counts` (a written table)."""
    passes = -(-counts.count() // max_pairs)
    out = aligned.withColumn("n_best", F.lit(0).cast("bigint")).withColumn("count_sum", F.lit(0).cast("bigint"))
    for k in range(passes):
        part = counts.where(_part(F.col("pair"), passes) == k).toArrow()
        pair = part.column("pair").to_numpy()
        order = np.argsort(pair)
        table = aligned.sparkSession.sparkContext.broadcast((pair[order], part.column("docs").to_numpy()[order], part.column("best").to_numpy()[order].astype(np.int64)))
        out = out.withColumn("found", _looked_up(table)("pairs", "times"))
        out = out.withColumn("n_best", F.col("n_best") + F.col("found.best")).withColumn("count_sum", F.col("count_sum") + F.col("found.docs")).drop("found")
        if k < passes - 1:
            out = staged(out, "counted")
            table.destroy()
    return out


def _part(pair: Column, passes: int) -> Column:
    return F.pmod(F.xxhash64(pair), F.lit(passes))


def alignment_report(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = staged(alignments(docs, byte_bpe, pieces, groups=False), "aligned")
    counts = staged(pair_counts(aligned), "pairs")
    out = with_counts(aligned, counts, max_pairs)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
