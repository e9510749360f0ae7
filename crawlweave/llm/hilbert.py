"""Sharding by a Hilbert curve over metadata, for files that many kinds of filter can skip.

Source, language and text size are quantised to 16 levels each: the two names by rank among the distinct values, the size by
its logarithm. Rows are sorted by the Hilbert index of their cell (Skilling, AIP Conf. Proc. 707, 2004), then by a hash group
of doc_id, then doc_id, and the sequence is cut into runs of equal row counts (law `rows`). A row's rank is a sum of three
counts: of the cells before, of the groups before it in the cell, and of the rows before it in the group. Cells have 4,096
values at most and a group about `GROUP` rows, so no window holds a hot cell whole.

Defined results: null texts have size 1; null names are the first level; null doc_ids come first; equal rows take
neighbouring slots; with fewer rows than shards the last shards are empty; an empty table gives an empty result. Only
doc_id, text, source and lang are read; other columns ride along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crawlweave.llm.staging import fresh, staged

SHARDS, BITS, GROUP = 8, 4, 1_000


def _levels(df: DataFrame, name: str) -> DataFrame:
    """Each distinct value of a name (one row a value) with its level."""
    distinct = df.select(F.col(name).alias("value")).distinct()
    last = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col("value").asc_nulls_first())) - 1
    return distinct.select("value", F.floor(rank * (1 << BITS) / F.greatest(last, F.lit(1 << BITS))).cast("int").alias("level"))


def hilbert_index(x: list[Column], df: DataFrame, out: str) -> DataFrame:
    """Add the Hilbert index of the integer coordinates x, each below 2**BITS."""
    names = [f"_h{i}" for i in range(len(x))]
    df = df.withColumns(dict(zip(names, x, strict=True)))
    first = F.col(names[0])
    for bit in range(BITS - 1, 0, -1):
        low = (1 << bit) - 1
        for name in names:
            there = F.col(name).bitwiseAND(1 << bit) != 0
            swap = first.bitwiseXOR(F.col(name)).bitwiseAND(low)
            changed = {names[0]: F.when(there, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap))}
            if name != names[0]:
                changed[name] = F.when(there, F.col(name)).otherwise(F.col(name).bitwiseXOR(swap))
            df = df.withColumns(changed)
    for a, b in zip(names, names[1:]):
        df = df.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    turn = F.lit(0)
    for bit in range(BITS - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(names[-1]).bitwiseAND(1 << bit) != 0, F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_turn", turn).withColumns({n: F.col(n).bitwiseXOR(F.col("_turn")) for n in names})
    index = F.lit(0).cast("bigint")
    for bit in range(BITS - 1, -1, -1):
        for name in names:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(name), bit).bitwiseAND(1).cast("bigint"))
    return df.withColumn(out, index).drop("_turn", *names)


def _group(groups: Column) -> Column:
    """Hash group of a row's doc_id."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint"), groups)


def sharded(docs: DataFrame, shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; with carry, the columns of docs, then shard and slot.

    Without carry only numbers are moved. With carry each row is moved once, behind its window.
    """
    text = F.col("text").cast("binary")
    keys = docs.select("doc_id", "source", "lang", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"))
    cells, ranked = _cells(staged(keys, "keys"))
    if carry:
        (row,) = fresh(docs, "row")
        whole = docs.select(F.struct(*docs.columns).alias(row), "doc_id", "source", "lang", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"))
        ranked = whole
    df = _placed(ranked, cells, shards)
    if not carry:
        return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    shard, slot = fresh(docs, "shard", "slot")
    return df.select(*[F.col(row)[c].alias(c) for c in docs.columns], F.col("shard").alias(shard), F.col("slot").alias(slot))


def _quantised(df: DataFrame, levels: dict[str, DataFrame]) -> DataFrame:
    for name, table in levels.items():
        side = table.select(F.col("value").alias("_v"), F.col("level").alias(f"_{name}"))
        df = df.join(side, df[name].eqNullSafe(side["_v"])).drop("_v")
    return df.withColumn("_size", F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.col("size").cast("double")))).cast("int"))


def _cells(keys: DataFrame):
    """Per cell its Hilbert index, rows before it, hash groups; and per (cell, group) the rows before that."""
    levels = {name: staged(_levels(keys, name), name) for name in ("source", "lang")}
    quantised = _quantised(keys, levels)
    cells = quantised.groupBy("_source", "_lang", "_size").agg(F.count("*").alias("n"))
    cells = hilbert_index([F.col("_source"), F.col("_lang"), F.col("_size")], cells, "_curve")
    before = Window.orderBy("_curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_all", F.sum("n").over(Window.partitionBy()))
    cells = staged(cells.withColumn("_groups", F.ceil(F.col("n") / GROUP)).drop("n"), "cells")
    grouped = quantised.join(cells, ["_source", "_lang", "_size"]).withColumn("_group", _group(F.col("_groups")))
    counts = grouped.groupBy("_curve", "_group").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("_curve").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = staged(counts.select("_curve", "_group", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead")), "groups")
    return (levels, cells, groups), keys


def _placed(rows: DataFrame, tables, shards: int) -> DataFrame:
    levels, cells, groups = tables
    df = _quantised(rows, levels).join(cells, ["_source", "_lang", "_size"]).withColumn("_group", _group(F.col("_groups")))
    df = df.join(groups, ["_curve", "_group"])
    inside = F.row_number().over(Window.partitionBy("_curve", "_group").orderBy("doc_id", "text_crc32", "size")) - 1
    df = df.withColumn("_rank", F.col("_base") + F.col("_ahead") + inside)
    least, more = F.floor(F.col("_all") / shards), F.col("_all") % shards  # the first `more` shards take one row more
    wide = more * (least + 1)
    shard = F.when(F.col("_rank") < wide, F.floor(F.col("_rank") / (least + 1))).otherwise(more + F.floor((F.col("_rank") - wide) / F.greatest(least, F.lit(1))))
    df = df.withColumn("shard", shard.cast("int"))
    start = F.col("shard") * least + F.least(F.col("shard").cast("bigint"), more)
    return df.withColumn("slot", F.col("_rank") - start)
