"""Document fingerprints from closed syncmers, in column functions only.

A k-mer of K characters is a closed syncmer if the least hash among its inner substrings of S characters is that of the first
or the last (Edgar, PeerJ 2021). Whether it is one depends on the k-mer alone, so texts that share a passage share
its anchors wherever the passage stands, and a text can be worked on in pieces that overlap by K - 1 characters. The
fingerprint is the `KEEP` least of the anchors' 32-bit hashes, as hexadecimal digits; the likeness of two fingerprints is the
share of common ones among the KEEP least of both, an estimate of the Jaccard index of their anchors.

An edited text differs from its document behind a point; anchors before it are the document's, only the new end and the K - 1
characters before it are read again. The text table is shuffled once (the same exchange serves the documents and the
heads that move to their predecessors); heads are at most a quarter of their new document.

Defined results: null is empty; an empty text has the empty fingerprint, alike (1.0) to an empty one only; a text shorter than K
has the hash of the whole; equal texts have equal fingerprints; a null doc_id comes after all others; among rows with one
doc_id the next document is the first of the next id by a hash of the text, and all of them have the same next
one; a lone document is its own next; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from crawlweave.llm.staging import staged

K, S, KEEP = 16, 12, 64
#: Characters worked on at a time, which bounds memory for long texts.
PIECE = 1 << 15
_LAST = (1 << 63) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(*parts: Column) -> Column:
    return F.shiftright(F.xxhash64(*parts), 32).cast("int")


def piece_anchors(piece: Column) -> Column:
    """array<struct<at, hash>>: closed syncmers of a string with their 0-based places."""
    span = K - S  # a k-mer has span + 1 inner substrings

    def chosen(h: Column) -> Column:
        def judge(first: Column, i: Column) -> Column:
            last, inner = F.get(h, i + span), [F.get(h, i + j) for j in range(1, span)]
            return F.when(F.least(*inner) >= F.least(first, last), F.struct(i.alias("at"), _hash(first, last).alias("hash")))

        return F.array_compact(F.transform(F.slice(h, 1, F.greatest(F.size(h) - span, F.lit(0))), judge))

    grams = F.regexp_extract_all(piece, F.lit(f"(?s)(?=(.{{{S}}}))."), F.lit(1))
    return let(F.transform(grams, lambda g: F.xxhash64(g)), chosen)


def anchors(text: Column) -> Column:
    """array<struct<at, hash>> of a whole text, for positional matching."""
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(text) - K + 1) / PIECE) - 1, F.lit(0)).cast("int"))
    found = F.transform(pieces, lambda j: F.transform(piece_anchors(F.substring(text, j * PIECE + 1, F.lit(PIECE + K - 1))), lambda a: F.struct((a["at"] + j * PIECE).alias("at"), a["hash"].alias("hash"))))
    return F.flatten(found)


def lowest(hashes: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, KEEP)


def sketches(text: Column, kept: Column) -> Column:
    """struct<whole, head>: the KEEP least hashes of a text and of its first `kept` characters, piece by piece."""
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(text) - K + 1) / PIECE) - 1, F.lit(0)).cast("int"))

    def of_piece(j: Column) -> Column:
        found = piece_anchors(F.substring(text, j * PIECE + 1, F.lit(PIECE + K - 1)))
        hashes = lambda a: lowest(F.transform(a, lambda x: x["hash"]))
        return let(found, lambda a: F.struct(hashes(a).alias("whole"), hashes(F.filter(a, lambda x: x["at"] + j * PIECE <= kept - K)).alias("head")))

    return let(F.transform(pieces, of_piece), lambda parts: F.struct(lowest(F.flatten(F.transform(parts, lambda p: p["whole"]))).alias("whole"), lowest(F.flatten(F.transform(parts, lambda p: p["head"]))).alias("head")))


def short(text: Column, sketch: Column) -> Column:
    """A text below K characters is one anchor, an empty one none."""
    none = F.expr("cast(array() as array<int>)")
    return F.when(F.length(text) == 0, none).when(F.length(text) < K, F.array(_hash(text))).otherwise(sketch)


def digits(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda v: F.lpad(F.lower(F.hex(v.cast("bigint").bitwiseAND((1 << 32) - 1))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among the KEEP least of two sketches."""
    share = let(lowest(F.concat(a, b)), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share)


def _successors(ids: DataFrame) -> DataFrame:
    """ids (d and further columns, d distinct) with `next`, the following d in order, the first behind the last.

    Ids are ranged over partitions and written with the partition's number; only one row per partition crosses its border.
    """
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(ids.repartitionByRange(n, "d").withColumn("part", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy("part").agg(F.min("d").alias("first"))
    order = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("beyond"))
    inside = ranged.withColumn("next", F.lead("d").over(Window.partitionBy("part").orderBy("d")))
    return inside.join(firsts, "part").withColumn("next", F.coalesce("next", "beyond")).drop("part", "beyond")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # both readers of the dealt texts take the same two columns, so that one shuffle serves them
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("d"), text.alias("text"))
    ids = texts.groupBy("d").agg(F.max(F.floor(F.length("text") / 4)).alias("wanted"), F.min(F.xxhash64("text")).alias("x"))
    after = staged(_successors(ids), "successors")
    dealt = texts.repartition(n, "d")
    # heads of documents for those before them
    heads = after.select(F.col("next").alias("d"), F.col("d").alias("before"), "wanted")
    heads = heads.join(after.select("d", "x"), "d")
    # written so that it isn't taken for a second join key, for which the texts would be shuffled anew
    moved = dealt.join(heads, "d").where(F.xxhash64("text").bitwiseXOR(F.col("x")) == 0)
    moved = moved.select(F.col("before").alias("d"), F.substring(F.col("text"), F.lit(1), F.col("wanted").cast("int")).alias("head"))
    moved = moved.groupBy("d").agg(F.first("head").alias("head"))
    rows = dealt.join(moved, "d").withColumn("n_chars", F.length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("kept", F.col("n_chars").cast("int") - cut).withColumn("tail", F.substring(F.col("head"), F.lit(1), cut))
    rows = rows.withColumn("sk", sketches(F.col("text"), F.col("kept")))
    start = F.greatest(F.col("kept") - K + 2, F.lit(1))
    seam = F.concat(F.substring(F.col("text"), start, F.col("kept") - start + 1), F.col("tail"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("kept")), F.col("tail"))
    rows = rows.withColumn("edited", edited).withColumn("seam", sketches(seam, F.lit(0))["whole"])
    done = rows.select(
        "d", F.xxhash64("text").alias("x"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), short(F.col("text"), F.col("sk")["whole"]).alias("own"),
        short(F.col("edited"), lowest(F.concat(F.col("sk")["head"], F.col("seam")))).alias("new"),
    )
    done = staged(done, "fingerprints")
    following = after.select("d", "next")
    lead = done.join(after.select("d", "x"), ["d", "x"]).groupBy(F.col("d").alias("next")).agg(F.first("own").alias("following"))
    out = done.join(following, "d").join(lead, "next")
    doc_id = F.when(F.col("d") != _LAST, F.col("d")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return out.select(doc_id, "n_chars", "edited_sha256", digits(F.col("own")).alias("fingerprint"), digits(F.col("new")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
