"""Line dedup by an exact set-similarity join, in column functions only: a line that resembles an earlier one goes.

A line is the set of its words. Lines with equal sets are one class, placed where it first occurs; every later line of a
class goes. Of the classes, those go that have a Jaccard index of 0.8 or more with a class placed earlier (itself kept or not):

1. Words are ordered by rarity: by a count over all texts in a fixed table of `BUCKETS` counters (a byte each), then by hash. The keys
   of the inverted index are pairs of neighbours in that order. A word that one of two sets lacks ruins at most two pairs of the
   set that has it and parts at most one of the other's, so similar sets share one of their first pairs, one more than can be
   ruined: about 0.4 n of a set of n words. Two words together are rare also where single ones are frequent.
2. Keys with one entry leave. Those with at most `FEW` entries are joined with themselves: at most so many partners an entry.
3. The entries of more frequent keys are met in rounds: first a small share of the classes, drawn by hash, is joined with all,
   then four times as many, at last all. A class that has matched leaves before the next round, so that members of large
   groups of near copies meet few others, while a class without a match has met every earlier entry of its keys in the end.

The joins let a pair through only if its sizes allow the overlap, its positions do (what can be common before and behind the
shared word), and its parity words do: each set has 128 bits in two words, one flipped by each word of the set, and two sets
differ in at least as many words as bits. What is left is verified on the hashes of all their words.

Defined results: a null text has no lines, an empty one has one blank line; lines without words stay; order is doc_id
(null last), then line number; rows with one doc_id count as one document and share their line numbers (one stays in all of
them or in none), so equal rows have equal results; very long lines are sets like any others; an empty table gives an empty
result. Only doc_id and text are read. Equal sets are told by two 64-bit hashes, words by one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from crawlweave.llm.staging import staged

OVER, UNDER = 80, 100
BUCKETS = 1 << 18
#: The keys of the inverted index are met in so many passes, one after the other, so that the disk holds a share of it at a time.
PASSES = 3
#: A key with more entries than this is met in rounds.
FEW = 64
#: Found in a line that has words.
FILLED = r"[^\x20\x09-\x0D]"
_LAST = (1 << 63) - 1


def _texts(docs: DataFrame) -> DataFrame:
    d = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("d")
    return docs.select(d, F.split(F.col("text").cast("string"), "\n").alias("lines"))


def lines_of(docs: DataFrame) -> DataFrame:
    """d, i, line: every line of every text."""
    return _texts(docs).select("d", F.posexplode("lines").alias("i", "line"))


def pieces_of(line: Column) -> Column:
    """The words of a line and empty texts between them; patterns are left to lines with white space other than blanks."""
    other = [F.contains(line, F.lit(c)) for c in "\t\n\v\f\r"]
    return F.when(reduce(or_, other), F.split(line, r"[\x20\x09-\x0D]")).otherwise(F.split(line, " "))


def words_of(line: Column) -> Column:
    """The distinct words of a line."""
    return F.array_remove(F.array_distinct(pieces_of(line)), "")


def hashes_of(line: Column) -> Column:
    """The hashes of the distinct words of a line, ascending."""
    hashes = F.array_distinct(F.transform(pieces_of(line), lambda w: F.xxhash64(w)))
    return F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(BUCKETS - 1).cast("int")


def rarity_table(lines: DataFrame) -> bytes:
    """BUCKETS bytes: for each bucket the count of its words in all lines, on a logarithmic scale with six steps a doubling."""
    words = lines.select(F.explode(pieces_of(F.col("line"))).alias("word"))
    counts = words.select(_bucket(F.xxhash64("word")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    every = lines.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    step = F.least(F.floor(F.log2(F.coalesce("n", F.lit(0)) + 1.0) * 6), F.lit(255))
    dense = every.join(counts, "bucket", "left").select("bucket", F.lpad(F.hex(step), 2, "0").alias("step"))
    digits = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "step"))), lambda x: x["step"])
    return bytes(dense.agg(F.unhex(F.array_join(digits, "")).alias("steps")).first()["steps"])


def _ranked(h: Column, rarity: bytes) -> Column:
    """The words as numbers in order of rarity: the counter of a word above 56 bits of its hash."""
    # one constant, folded once per plan
    steps = F.split(F.lit(",".join(str(x - 128) for x in rarity)), ",").cast("array<bigint>")
    # never null, so that the sort works on plain numbers
    step = lambda x: F.coalesce(F.get(steps, _bucket(x)), F.lit(0).cast("bigint"))
    return F.sort_array(F.transform(h, lambda x: F.shiftleft(step(x), 56).bitwiseOR(x.bitwiseAND((1 << 56) - 1))))


def needed(n: Column, m: Column) -> Column:
    """Least overlap of sets of n and m words with Jaccard >= OVER / UNDER."""
    return F.ceil((n + m) * OVER / (OVER + UNDER))


def _possible(a: str, b: str) -> Column:
    """Length, positional and parity filters on the entries a and b (struct columns n, at, low, high) of one key."""
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.at"), F.col(f"{b}.at")
    most = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    differ = sum(F.bit_count(F.col(f"{a}.{bits}").bitwiseXOR(F.col(f"{b}.{bits}"))) for bits in ("low", "high"))
    # distinct sets of one size share one word less than they have
    room = F.least(n, m) - F.when(n == m, 1).otherwise(0)
    need = needed(n, m)
    return (need <= room) & (need <= most) & (differ <= n + m - 2 * need)


def _pairs_ruined(n: Column) -> Column:
    """The most pairs of neighbours that a set of n words can lose to a set with Jaccard >= OVER / UNDER.

    A word that only this set has ruins two of them, one that only the other has parts one; smaller partners ruin more.
    """
    least = F.ceil(n * OVER / UNDER)
    return F.floor((n * (2 * UNDER - OVER) + least * (UNDER - 2 * OVER)) / (OVER + UNDER)).cast("int")


def _entries(classes: DataFrame) -> DataFrame:
    """t, d, i, n, low, high, at: the pairs of neighbours in the prefix of each class, t the hash of both words."""
    # sets of up to three words resemble none but their equals
    words = classes.where(F.col("n") > 3).select("d", "i", "n", "low", "high", "prefix", F.posexplode(F.slice("prefix", 1, F.size("prefix") - 1)).alias("at", "word"))
    return words.select(F.xxhash64("word", F.get("prefix", F.col("at") + 1)).alias("t"), "d", "i", "n", "low", "high", "at")


def _met(classes: DataFrame) -> DataFrame:
    """The entries whose t another entry has too, and how many have it; one pass over a share of the index after the other."""
    met, alike = [], Window.partitionBy("t")
    for k in range(PASSES):
        part = _entries(classes).where(F.pmod("t", F.lit(PASSES)) == k)
        met.append(staged(part.withColumn("entries", F.count("*").over(alike)).where(F.col("entries") > 1), "met"))
    return _union(met)


def _sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """d, i, words (their hashes) of the lines at distinct places; only these leave their texts."""
    wanted = places.groupBy("d").agg(F.collect_list("i").alias("wanted"))
    there = F.filter("wanted", lambda i: i < F.size("lines"))
    picked = F.transform(there, lambda i: F.struct(i.alias("i"), F.get("lines", i).alias("line")))
    sets = _texts(docs).join(wanted, "d").select("d", F.inline(picked)).groupBy("d", "i").agg(F.min("line").alias("line"))
    return sets.select("d", "i", hashes_of(F.col("line")).alias("words"))


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct d, i of pairs (d, i) - (d2, i2) that are similar, seen on all their words."""
    other = sets.select(F.col("d").alias("d2"), F.col("i").alias("i2"), F.col("words").alias("words2"))
    joined = pairs.join(sets, ["d", "i"]).join(other, ["d2", "i2"])
    both = F.size(F.array_intersect("words", "words2"))
    return staged(joined.where(both >= needed(F.size("words"), F.size("words2"))).select("d", "i").distinct(), "matched")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _pairs(late: DataFrame, early: DataFrame) -> DataFrame:
    """d, i, d2, i2: entries with earlier entries of their t that may be similar."""
    after = (F.col("a.d") > F.col("b.d")) | ((F.col("a.d") == F.col("b.d")) & (F.col("a.i") > F.col("b.i")))
    joined = late.alias("a").hint("merge").join(early.alias("b"), (F.col("a.t") == F.col("b.t")) & after & _possible("a", "b"))
    return staged(joined.select("a.d", "a.i", F.col("b.d").alias("d2"), F.col("b.i").alias("i2")).distinct(), "pairs")


def _matched_in_rounds(sets: DataFrame, many: DataFrame, hottest: int, matched: DataFrame) -> list[DataFrame]:
    """d, i of further classes, those that share a t of more than `FEW` entries with an earlier one they resemble."""
    found, share = [matched], 1
    while FEW * share * 4 <= hottest:
        share *= 4
    while share:
        # those that are too rare for this share wait for a larger one
        some = many.where(F.col("entries") >= FEW * share)
        late = some.join(_union(found), ["d", "i"], "left_anti")
        found.append(_verified(sets, _pairs(late, some.where(F.pmod(F.xxhash64("d", "i"), F.lit(share)) == 0))))
        share //= 4
    return found


def kept_classes(docs: DataFrame) -> DataFrame:
    """d, i of the lines with words that stay: first of their class, and no earlier class resembles it."""
    lines = lines_of(docs)
    rarity = rarity_table(lines)
    hashed = lines.where(F.regexp_like("line", F.lit(FILLED))).select("d", "i", hashes_of(F.col("line")).alias("h"))
    # how many hashes are negative: where a zero among them would be
    half = F.array_position(F.sort_array(F.array_append("h", F.lit(0).cast("bigint"))), F.lit(0).cast("bigint")).cast("int") - 1
    hashed = hashed.select("d", "i", "h", F.size("h").alias("n"), half.alias("half"))
    flip = lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(63).cast("int")))
    # the sign of a hash says which of the two parity words it flips
    low = F.aggregate(F.slice("h", 1, F.col("half")), F.lit(0).cast("bigint"), flip)
    high = F.aggregate(F.slice("h", F.col("half") + 1, F.col("n") - F.col("half")), F.lit(0).cast("bigint"), flip)
    # one pair more than can be ruined, and so two words more
    prefix = F.slice(_ranked(F.col("h"), rarity), F.lit(1), _pairs_ruined(F.col("n")) + 2)
    hashed = hashed.select("d", "i", "n", low.alias("low"), high.alias("high"), F.xxhash64("h").alias("s1"), F.xxhash64(F.lit(1), "h").alias("s2"), prefix.alias("prefix"))
    classes = hashed.groupBy("s1", "s2").agg(F.min(F.struct("d", "i")).alias("place"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("prefix").alias("prefix"))
    classes = staged(classes.select("place.d", "place.i", "n", "low", "high", "prefix"), "classes")
    met = _met(classes)
    few, many = met.where(F.col("entries") <= FEW), staged(met.where(F.col("entries") > FEW), "many")
    pairs = _pairs(few, few)
    ends = _union([pairs.select("d", "i"), pairs.select(F.col("d2").alias("d"), F.col("i2").alias("i")), many.select("d", "i")])
    # written first: the size of a small table is known when the join with the texts is planned
    sets = staged(_sets(docs, staged(ends.distinct(), "ends")), "sets")
    matched, hottest = [_verified(sets, pairs)], many.agg(F.max("entries").alias("most")).first()["most"]
    if hottest:
        matched = _matched_in_rounds(sets, many, hottest, matched[0])
    return classes.select("d", "i").join(_union(matched), ["d", "i"], "left_anti")


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 (of the remaining lines, joined by line ends)."""
    df = without_repeated_lines(docs.select("doc_id", "text"))
    return df.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text (the remaining lines), n_lines, n_removed."""
    stay = kept_classes(docs).groupBy("d").agg(F.collect_set("i").alias("stay"))
    text = F.col("text").cast("string").alias("text")
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("d"), text)
    rows = texts.join(stay, "d", "left").withColumn("lines", F.split("text", "\n"))
    none = F.expr("cast(array() as array<int>)")
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: ~F.regexp_like(F.get("lines", i), F.lit(FILLED)))
    # line numbers in order; other rows with this doc_id may have more lines
    stay = F.filter(F.array_union(F.coalesce("stay", none), blank), lambda i: i < F.size("lines"))
    rows = rows.withColumn("kept", F.when(F.col("lines").isNotNull(), F.transform(F.sort_array(stay), lambda i: F.get("lines", i))))
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("bigint")
    gone = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("bigint")
    return rows.select("doc_id", F.array_join("kept", "\n").alias("text"), size.alias("n_lines"), gone.alias("n_removed"))
