"""Language identification by words first, falling back to shorter and shorter character n-grams.

A word that the model knows is scored by its log frequency in each language. An unseen word is cut into known n-grams,
longest size first: where no n-gram of a size is known, the next shorter size is tried, down to single characters. The
document's score for a language is the mean over its words; the reported score is the softmax share of the best one.

The model is a classifier, so it is fitted on a bounded sample: at most `rows_per_language` labelled documents of each
language, chosen by a hash of doc_id (all of them where there are fewer), and it keeps the `max_words` commonest words and
`max_grams` commonest n-grams of each size per language, so what is broadcast has a fixed bound. Every document is predicted.

Defined results: null, empty and letterless texts are `und` with score 0; rows without lang teach nothing; with no
labelled row every text is `und`; equal texts get equal answers; ties go to the language first in code point order; very
long texts are read whole. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crawlweave.llm.hashing import in_slices
from crawlweave.llm.memory import release, released
from crawlweave.llm.staging import fresh, staged

ROWS_PER_LANGUAGE = 4_000
MAX_WORDS = 20_000
MAX_GRAMS = 5_000
SIZES = (4, 3, 2, 1)
#: Cost, in log units, of each step back to a shorter n-gram.
BACKOFF = 0.4
#: Documents whose best language has a smaller share than this are rejected too, not only `und` ones. By default none
#: are: a short text of rare words has a low share, but it has a language.
MIN_SCORE = 0.0
#: Documents of whose words the model knows less than this on average are rejected: unknown scripts and languages, encoded text,
#: gibberish. All held-out labelled documents of the given tables have more than 0.9, such texts less than 0.58.
MIN_KNOWN = 0.6


def training_rows(docs: DataFrame, rows_per_language: int) -> DataFrame:
    """Labelled (text, lang), at most about rows_per_language of each, picked by a hash of doc_id."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    share = {r["lang"]: min(1.0, rows_per_language / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(1000).collect()}
    if not share:
        return labelled.select("text", "lang")
    kept = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    return labelled.where(draw < kept).select("text", "lang")


def letters_and_words(text: str) -> Counter:
    """Lower-cased words made of letters only, with their counts."""
    words: Counter = Counter()
    for token, n in Counter(text.lower().split()).items():
        if token.isalpha():
            words[token] += n
        else:
            for word in "".join(c if c.isalpha() else " " for c in token).split():
                words[word] += n
    return words


def grams(word: str, size: int) -> list[str]:
    padded = f" {word} " if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


_PIECES = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("piece", pa.string()), ("n", pa.int64())])


def _flushed(totals: Counter) -> pa.RecordBatch:
    rows = list(totals.items())
    totals.clear()
    columns = [[k[0] for k, _ in rows], [k[1] for k, _ in rows], [k[2] for k, _ in rows], [n for _, n in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: Counter = Counter()
    for batch in in_slices(batches):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, n in letters_and_words(text).items():
                totals[lang, 0, word] += n
            if len(totals) > 50_000:
                yield _flushed(totals)
    yield _flushed(totals)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: Counter = Counter()
    for batch in in_slices(batches):
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for size in SIZES:
                for gram in grams(word, size):
                    totals[lang, size, gram] += n
        if len(totals) > 50_000:
            yield _flushed(totals)
    yield _flushed(totals)


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> dict:
    """Log frequencies by piece: {"langs": [...], size: {piece: (log p of each language)}}; size 0 holds words."""
    from pyspark.sql import Window

    schema, key = "lang string, size int, piece string, n bigint", ("lang", "size", "piece")
    words = staged(training_rows(docs, rows_per_language).mapInArrow(released(_count_words), schema).groupBy(*key).agg(F.sum("n").alias("n")), "words")
    parts = words.select("lang", "piece", "n").mapInArrow(released(_count_grams), schema).groupBy(*key).agg(F.sum("n").alias("n"))
    pieces = words.unionByName(staged(parts, "grams"))
    # a vocabulary per language: a piece in a language's commonest few is kept with its counts in all languages
    by_rank = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "piece")
    best = pieces.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= F.when(F.col("size") == 0, max_words).otherwise(max_grams))
    kept = best.select("size", "piece").distinct()
    rows = pieces.join(kept, ["size", "piece"], "left_semi").collect()
    total: Counter = Counter()
    for r in pieces.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        total[r["lang"], r["size"]] = r["n"] + r["kinds"]
    langs = sorted({k[0] for k in total})
    at = {lang: i for i, lang in enumerate(langs)}
    model: dict = {"langs": langs} | {size: {} for size in (0, *SIZES)}
    floor = {size: [math.log(0.1 / max(1, total[lang, size])) for lang in langs] for size in (0, *SIZES)}
    for r in rows:
        model[r["size"]].setdefault(r["piece"], list(floor[r["size"]]))[at[r["lang"]]] = math.log(r["n"] / total[r["lang"], r["size"]])
    return model


def judged_word(model: dict, word: str) -> tuple[list[float] | None, float]:
    """Log score of a word in each language, None if not even a letter of it is known; how much of it is known: all of a word
    of the model, else the share of its n-grams of the first size that has any, nothing for single characters."""
    known = model[0].get(word)
    if known is not None:
        return known, 1.0
    for step, size in enumerate(SIZES):
        parts = grams(word, size)
        found = [s for g in parts if (s := model[size].get(g)) is not None]
        if found:
            scores = [sum(column) / len(found) - BACKOFF * (step + 1) for column in zip(*found, strict=True)]
            return scores, len(found) / len(parts) if size > 1 else 0.0
    return None, 0.0


def word_scores(model: dict, word: str) -> list[float] | None:
    return judged_word(model, word)[0]


def judged(model: dict, text: str | None, cache: dict) -> tuple[str, float, float]:
    """Language, score, and how much of the text's words the model knows on average."""
    langs = model["langs"]
    words = letters_and_words(text) if text else None
    if not words or not langs:
        return "und", 0.0, 0.0
    sums, seen, known = [0.0] * len(langs), 0, 0.0
    for word, n in words.items():
        found = cache.get(word)
        if found is None:
            if len(cache) > 50_000:
                cache.clear()
            found = cache[word] = judged_word(model, word)
        scores, share = found
        if scores is not None:
            seen += n
            known += n * share
            for i, s in enumerate(scores):
                sums[i] += n * s
    known /= sum(words.values())
    if not seen:
        return langs[0], 1.0 / len(langs), 0.0
    # evidence grows with the words up to ten, so that one known word doesn't make a certainty
    scale = min(seen, 10) / seen
    best = max(range(len(langs)), key=lambda i: (sums[i], -i))
    return langs[best], 1.0 / sum(math.exp(max(-700.0, (s - sums[best]) * scale)) for s in sums), known


def predict_one(model: dict, text: str | None, cache: dict) -> tuple[str, float]:
    return judged(model, text, cache)[:2]


def predictor(model: dict):
    """A column function text -> struct(lang, score, known)."""
    cache: dict = {}

    @F.arrow_udf("struct<lang:string,score:double,known:double>")
    def predict(text: pa.Array) -> pa.Array:
        rows = [judged(model, t.as_py(), cache) for t in text]
        release()
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))], ["lang", "score", "known"])

    return predict


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that aren't held out (a null doc_id isn't)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    out = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), predictor(model)(F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def with_known_language(docs: DataFrame, min_score: float = MIN_SCORE, min_known: float = MIN_KNOWN) -> DataFrame:
    """The documents whose text has a language, with their own columns; `und` ones, those below min_score and those of whose
    words less than min_known is known go."""
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    (name,) = fresh(docs, "language")
    # written here, a thousand texts at a time: the executors hold what earlier stages needed already
    out = staged(docs.withColumn(name, predictor(model)(F.col("text").cast("string"))), "languages", arrow_rows=1_000)
    known = (F.col(name)["known"] > 0) & (F.col(name)["known"] >= min_known)
    return out.where((F.col(name)["lang"] != "und") & (F.col(name)["score"] >= min_score) & known).drop(name)
