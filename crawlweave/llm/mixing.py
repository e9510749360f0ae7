"""Mixing sources to target weights with fixed-length token blocks.

Each source's documents, in a fixed pseudorandom order, form one stream of words, cut into blocks of `BLOCK` words. A source
with target t of its S words gets K = round(t * blocks / S) slots. Slot j of a source goes to block P(j mod blocks), where P is
a pseudorandom permutation of the source's block numbers, another one in each pass j div blocks; so every block is taken
floor(K/blocks) or one more times. Slots are dealt to output positions, and so to shards, by another permutation of all slots:
the source counts per shard are a multinomial draw given the totals, so no sampling noise is left in the totals. Blocks
meet their slots in a join on (source, block number).

The permutations are swap-or-not networks (Hoang, Morris, Rogaway, CRYPTO 2012), which work on any range with column
functions alone; nothing is shuffled to make them and reruns agree.

Defined results: null, empty and blank texts have size 0 and are never taken; a null source is a source of its own, last in
order; a source without words has target 0; equal rows are told apart only by their place in the stream; a null doc_id is
kept; an empty table gives an empty result. Only doc_id, text and source are read; other columns ride along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crawlweave.llm.staging import fresh, staged

BLOCK = 64
SHARDS = 64
#: Fixed by the contract: weights by the order of sources, and how often a source may be repeated.
WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that share one running sum; slots made by one generator row.
RUN, PAGE = 2_000, 65_536
ROUNDS = 8


def _bits(*parts) -> Column:
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def permuted(x: Column, size: Column, key: list[Column], rounds: int = ROUNDS) -> Column:
    """Image of x, in [0, size), under the permutation that `key` names."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(_bits("turn", r, *key), size) - x, size)
        return F.when(_bits("swap", r, *key, F.greatest(x, partner)).bitwiseAND(1) == 1, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), x, turn)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and two hashes that stand for the row."""
    row = [F.col("doc_id"), F.col("source"), F.col("text")]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", size.alias("size"), _bits("a", *row).alias("h1"), _bits("b", *reversed(row)).alias("h2"))


def targets(sizes: DataFrame, block: int = BLOCK, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, n_rows, source_size, target, blocks, slots.

    A target is weight * level, or `most` times the size if that is less. Sorted by size/weight, the capped sources come first, so
    running sums over this table (one row a source) give the level without repeating the resharing.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    first = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = first.rowsBetween(Window.unboundedPreceding, -1), first.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    # the level of the first source that isn't capped holds for all that follow
    held = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * held))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / block))
    slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint"), most * F.col("blocks")))
    return per.select("source", "n_rows", "source_size", "target", "blocks", F.coalesce(slots, F.lit(0)).alias("slots"))


def slots_of(per_source: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source, block, shard, position: every slot of the mix."""
    ahead = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per_source.where("slots > 0").select("source", "blocks", "slots", F.coalesce(F.sum("slots").over(ahead), F.lit(0)).alias("first"))
    per = per.withColumn("all", F.sum("slots").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pages = per.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("slots") - 1, F.lit(PAGE).cast("bigint"))))
    # a page is a small row that becomes many: dealt by number, as by size they would all go to one task
    pages = pages.repartition(int(per.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "page")
    slot = F.explode(F.sequence("page", F.least(F.col("page") + PAGE, F.col("slots")) - 1))
    df = pages.select("source", "blocks", "first", "all", slot.alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    df = df.withColumn("block", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), [F.col("source"), turn]))
    df = df.withColumn("position", permuted(F.col("first") + F.col("slot"), F.col("all"), [F.lit("deal")]))
    shard = F.floor(F.col("position") * shards / F.col("all")).cast("int")
    return df.select("source", "block", shard.alias("shard"), "position")


def pieces_of(sizes: DataFrame, per_source: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each stretch of a document inside one block: the columns of sizes, source_size, target, start, block, low, length.

    A document's place in its source's stream is a running sum in two steps: within runs of about RUN rows picked by hash, and
    over the runs, so a source with a third of all rows is many tasks.
    """
    per = per_source.select(F.col("source").alias("s"), F.ceil(F.col("n_rows") / RUN).alias("runs"), "source_size", "target")
    df = sizes.join(per, sizes["source"].eqNullSafe(per["s"])).drop("s").withColumn("run", F.pmod(F.col("h1"), F.col("runs")))
    totals = df.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("run_size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "run").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    df = df.join(totals, df["source"].eqNullSafe(totals["s"]) & (df["run"] == totals["r"])).withColumn("start", F.col("start") + F.col("base"))
    df = df.drop("s", "r", "base", "run", "runs")
    covers = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    df = df.where("size > 0").withColumn("block", F.explode(covers))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return df.withColumn("low", low - F.col("start")).withColumn("length", high - low)


def _dealt(sizes: DataFrame, per_source: DataFrame, block: int, shards: int = SHARDS) -> DataFrame:
    """The mix, written: the pieces of each slot's block with the slot's shard and position, shards being runs of positions.

    Pieces of blocks without a slot are there once, with null for both.
    """
    slots = slots_of(per_source, shards).withColumnsRenamed({"source": "s", "block": "b"})
    slots = slots.hint("merge")  # it grows with the words, though the table it comes from is tiny
    pieces = pieces_of(sizes, per_source, block)
    joined = pieces.join(slots, pieces["source"].eqNullSafe(slots["s"]) & (pieces["block"] == slots["b"]), "left")
    wanted = ["doc_id", "source", "size", "source_size", "target", "h1", "h2", "start", "block", "low", "length", "shard", "position"]
    return staged(joined.select(wanted), "mix")


def mix_report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (its words in the blocks of the mix)."""
    sizes = staged(sized(docs), "sizes")
    per_source = staged(targets(sizes, block), "targets")
    taken = _dealt(sizes, per_source, block).groupBy("source", "start", "doc_id", "size", "source_size", "target")
    taken = taken.agg(F.sum(F.when(F.col("position").isNotNull(), F.col("length")).otherwise(0)).alias("taken"))
    per = per_source.select(F.col("source").alias("s"), "source_size", "target")
    empty = sizes.where("size = 0").join(per, sizes["source"].eqNullSafe(per["s"])).withColumn("taken", F.lit(0).cast("bigint"))
    wanted = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(wanted).unionByName(empty.select(wanted))


def mixed_blocks(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """The mix as blocks: source, block, shard, position, n_words, text. Positions run from 0 through all shards in turn.

    A block's words are joined by blanks. Each document is cut into its pieces once, each block is put together once, and then
    joined to its slots.
    """
    sizes = staged(sized(docs), "sizes")
    per_source = staged(targets(sizes, block), "targets")
    parts = pieces_of(sizes, per_source, block).groupBy("h1", "h2")
    parts = parts.agg(F.collect_list(F.struct(F.struct("source", "block").alias("key"), "start", "low", "length")).alias("parts"))
    texts = docs.select(*_row_hashes(), "text").dropDuplicates(["h1", "h2"]).join(parts, ["h1", "h2"])
    # the outer transform holds the words, so that they are found once a document and not once a piece
    words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    cut = lambda w, p: F.array_join(F.slice(w, (p["low"] + 1).cast("int"), p["length"].cast("int")), " ")
    piece = lambda w: lambda p: F.struct(p["key"].alias("key"), p["start"].alias("start"), p["length"].alias("length"), cut(w, p).alias("text"))
    pieces = texts.select(F.explode(F.element_at(F.transform(words, lambda w: F.transform("parts", piece(w))), 1)).alias("p")).select("p.*")
    # one key, a struct as sources may be null
    blocks = pieces.groupBy("key").agg(F.sum("length").alias("n_words"), F.sort_array(F.collect_list(F.struct("start", "text")))["text"].alias("text"))
    slots = slots_of(per_source, shards).select(F.struct("source", "block").alias("key"), "shard", "position").hint("merge")
    out = slots.join(blocks, "key")
    return out.select("key.source", "key.block", "shard", "position", "n_words", F.array_join("text", " ").alias("text"))


def _row_hashes() -> list[Column]:
    key = [F.col("doc_id"), F.col("source"), F.col("text")]
    return [_bits("a", *key).alias("h1"), _bits("b", *reversed(key)).alias("h2")]


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents, with the columns of docs: one row for each time that words of a document are taken.

    Row k of a document holds the words of its blocks that are taken more than k times; a text taken whole is left as it is,
    otherwise its taken words are joined by blanks, and n_chars, where docs has it, is their length.
    """
    sizes = staged(sized(docs), "sizes")
    per_source = staged(targets(sizes, block), "targets")
    parts = _dealt(sizes, per_source, block).where("position is not null").groupBy("h1", "h2", "start", "size", "low", "length").agg(F.count("*").alias("times")).groupBy("h1", "h2", "start", "size")
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("low", "length", "times"))).alias("parts"), F.max("times").alias("most"))
    copies = parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("most") - 1)))
    kept = F.filter("parts", lambda p: p["times"] > F.col("k"))
    copies = copies.select("h1", "h2", "size", kept.alias("kept"))
    copies = copies.groupBy("h1", "h2").agg(F.collect_list(F.struct("size", "kept")).alias("copies"))
    row, one = fresh(docs, "row", "copy")
    texts = docs.select(*_row_hashes(), F.struct(*docs.columns).alias(row))
    texts = texts.groupBy("h1", "h2").agg(F.first(row).alias(row))  # equal rows share their copies
    out = texts.join(copies, ["h1", "h2"]).select(row, F.explode("copies").alias(one))
    whole = F.aggregate(F.col(one)["kept"], F.lit(0).cast("bigint"), lambda a, p: a + p["length"]) == F.col(one)["size"]
    words = F.regexp_extract_all(F.col(row)["text"], F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(F.col(one)["kept"], lambda p: F.slice(words, (p["low"] + 1).cast("int"), p["length"].cast("int")))), " ")
    out = out.select(*[F.col(row)[c].alias(c) for c in docs.columns if c != "text"], F.when(whole, F.col(row)["text"]).otherwise(cut).alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
