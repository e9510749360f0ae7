"""Cleaned HTML to markdown over token rows.

One shuffle on the page (none, if the input is already spread by it); every window and group after
that lies inside a page. Headings, lists with nesting, quotes, fences, tables, links, images, bold,
italic and code are written; unclosed inline marks end with their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.html import (
    BLOCK_TAGS, WS, attribute, collapse, decode_entities, is_blank, is_tag, tag_attrs, tag_name, tokens,
)

_TABLE_TAGS = ["table", "thead", "tbody", "tfoot", "tr", "td", "th"]
_BR = "\x01"  # stands for a line break until white space has been collapsed


def _listagg(col: str, order: str) -> Column:
    return F.expr(f"listagg({col}, '') within group (order by {order})")


def to_markdown(contents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``page_id``, the columns to keep, ``markdown``. Pages without text give an empty text.

    Kept columns travel on one row per page, in front of its first token.
    """
    items = _items(_placed(_token_rows(contents, keep)))
    pages = _pages(_blocks(_marked(items)))
    return pages.select("page_id", *[F.col("_keep")[c].alias(c) for c in keep], "markdown")


def _token_rows(contents: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    raw = F.col("_raw")
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(True))
    content = F.coalesce("content", F.lit(""))
    return (
        contents.repartition("page_id").select("page_id", content.alias("content"), kept.alias("_keep"))
        .select("page_id", "_keep", F.posexplode(F.concat(F.array(F.lit("")), tokens(F.col("content")))).alias("idx", "_raw"))
        .select(
            "page_id", "idx", F.when(F.col("idx") == 0, F.col("_keep")).alias("_keep"), raw.alias("raw"),
            F.when(is_tag(raw), tag_name(raw)).otherwise("").alias("tag"),
            F.when(is_tag(raw), F.when(raw.startswith("</"), -1).otherwise(1)).otherwise(0).alias("dir"),
        )
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Where each token stands: inside pre, lists, quotes, table cells; and which block it is in."""
    on_page = Window.partitionBy("page_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tag, direction = F.col("tag"), F.col("dir")

    def running(*tags: str) -> Column:
        return F.sum(F.when(tag.isin(*tags), direction).otherwise(0)).over(on_page)

    def clamped(name: str) -> Column:
        # stray end tags do not push the depth below zero
        return F.col(name) - F.least(F.lit(0), F.min(name).over(on_page))

    opens = direction == 1
    rows = rows.select(
        "*",
        running("pre").alias("_s_pre"), running("ul", "ol").alias("_s_list"), running("blockquote").alias("_s_quote"),
        F.coalesce(F.last(
            F.when(tag.isin("td", "th") & opens, F.col("idx")).when(tag.isin(*_TABLE_TAGS), -1), ignorenulls=True
        ).over(on_page), F.lit(-1)).alias("cell_id"),
        F.coalesce(F.last(
            F.when((tag == "tr") & opens, F.col("idx")).when(tag.isin("tr", "table"), -1), ignorenulls=True
        ).over(on_page), F.lit(-1)).alias("row_id"),
        F.coalesce(F.last(F.when((tag == "table") & opens, F.col("idx")), ignorenulls=True).over(on_page), F.lit(-1)).alias("table_id"),
    )
    rows = rows.select(
        "page_id", "idx", "_keep", "raw", "tag", "dir", "row_id", "table_id",
        F.when(F.col("row_id") >= 0, F.col("cell_id")).otherwise(-1).alias("cell_id"),
        clamped("_s_pre").alias("_pre"), clamped("_s_list").alias("list_depth"), clamped("_s_quote").alias("quote_depth"),
    )
    rows = rows.withColumn("in_pre", (F.col("_pre") > 0) & (F.col("cell_id") < 0))
    breaks = F.when(F.col("cell_id") >= 0, tag.isin(*_TABLE_TAGS)).when(
        F.col("in_pre"), (tag == "pre") & (F.col("_pre") == 1)
    ).otherwise(tag.isin(*BLOCK_TAGS))
    # a rule has no end tag: what follows it is a new block
    before = Window.partitionBy("page_id").orderBy("idx")
    after_rule = F.coalesce(F.lag(F.col("_breaks") & (tag == "hr")).over(before), F.lit(False))
    rows = rows.withColumn("_breaks", breaks).withColumn("is_break", F.col("_breaks") | after_rule).withColumn(
        "block_no", F.sum(F.col("is_break").cast("int")).over(on_page)
    )
    at_depth = (
        Window.partitionBy("page_id", "list_depth").orderBy("idx")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    is_item = (tag == "li") & opens
    rows = rows.withColumn("_items", F.sum(is_item.cast("int")).over(at_depth))
    rows = rows.withColumn(
        "_list",
        F.last(F.when(tag.isin("ul", "ol") & opens,
                      F.struct("idx", (tag == "ol").alias("ordered"), F.col("_items").alias("before"))), ignorenulls=True).over(at_depth),
    ).withColumn("_li", F.last(F.when(is_item, F.col("idx")), ignorenulls=True).over(at_depth))
    inside = (F.col("list_depth") > 0) & (F.col("_li") > F.col("_list.idx")) & (F.col("cell_id") < 0)
    return rows.select(
        "page_id", "idx", "_keep", "raw", "tag", "dir", "row_id", "table_id", "cell_id", "quote_depth", "in_pre", "is_break", "block_no",
        F.when(inside, F.col("list_depth")).otherwise(0).alias("list_depth"),
        F.when(inside, F.col("_li")).otherwise(-1).alias("li_id"),
        F.when(inside, F.col("_list.idx")).otherwise(-1).alias("list_id"),
        F.when(inside & F.col("_list.ordered"), F.col("_items") - F.col("_list.before")).otherwise(0).alias("li_no"),
    )


def _items(rows: DataFrame) -> DataFrame:
    """Texts, images and line breaks of each block, with the inline marks that hold for them."""
    in_block = (
        Window.partitionBy("page_id", "block_no").orderBy("idx")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    tag, direction, raw = F.col("tag"), F.col("dir"), F.col("raw")

    def running(*tags: str) -> Column:
        return F.sum(F.when(tag.isin(*tags), direction).otherwise(0)).over(in_block)

    def holds(name: str) -> Column:
        return F.col(name) - F.least(F.lit(0), F.min(name).over(in_block)) > 0

    link = F.when((tag == "a") & (direction == 1),
                  F.struct(F.col("idx").alias("id"), attribute(tag_attrs(raw), "href").alias("href"))).when(
        tag == "a", F.struct(F.lit(-1).alias("id"), F.lit(None).cast("string").alias("href")))
    rows = rows.select(
        "*", running("b", "strong").alias("_s_b"), running("i", "em").alias("_s_i"),
        running("code", "kbd", "samp", "tt").alias("_s_c"),
        F.last(link, ignorenulls=True).over(in_block).alias("_link"),
        F.first("tag").over(in_block).alias("_head_tag"), F.first("is_break").over(in_block).alias("_head_break"),
        F.first("dir").over(in_block).alias("_head_dir"),
    )
    linked = (F.col("_link.id") >= 0) & F.col("_link.href").isNotNull()
    image = F.concat(
        F.lit("!["), collapse(F.coalesce(attribute(tag_attrs(raw), "alt"), F.lit(""))), F.lit("]("),
        attribute(tag_attrs(raw), "src"), F.lit(")"),
    )
    is_text = (direction == 0) & ~raw.rlike(r"\A<[!?]")
    inner_block = tag.isin(*BLOCK_TAGS) & ~F.col("is_break")
    text = (
        F.when(is_text & F.col("in_pre"), decode_entities(raw))
        .when(is_text, collapse(decode_entities(raw)))
        .when(F.col("in_pre"), F.when((tag == "br") | (inner_block & (direction == -1)), "\n"))
        .when((tag == "img") & (direction == 1), image)
        .when(tag == "br", F.when(F.col("cell_id") >= 0, " ").otherwise(_BR))
        .when((tag == "hr") & (direction == 1) & F.col("is_break"), "---")
        .when((F.col("cell_id") >= 0) & F.col("is_break"), "")
        .when((F.col("cell_id") >= 0) & inner_block, " ")
    )
    level = F.regexp_extract("_head_tag", r"\Ah([1-6])\z", 1)
    return (
        rows.select("*", holds("_s_b").alias("bold"), holds("_s_i").alias("ital"), holds("_s_c").alias("code"),
                    text.alias("text"))
        .where("text IS NOT NULL")
        .select(
            "page_id", "block_no", "idx", "_keep", "text",
            (~F.col("in_pre") & ~is_blank(F.regexp_replace("text", _BR, ""))).alias("solid"),
            F.when(linked, F.col("_link.id")).otherwise(-1).alias("link_id"), F.col("_link.href").alias("href"),
            "bold", "ital", "code",
            F.struct(
                "idx", "in_pre", "quote_depth", "list_depth", "li_id", "list_id", "li_no", "cell_id", "row_id", "table_id",
                F.when(F.col("_head_break") & (F.col("_head_dir") == 1) & (level != ""), level.try_cast("int")).otherwise(0).alias("level"),
            ).alias("at"),
        )
    )


def _marked(items: DataFrame) -> DataFrame:
    """Write each mark where its run of texts starts and ends; blanks stay outside the marks."""
    run = Window.partitionBy("page_id", "block_no", "solid").orderBy("idx")
    state = F.struct("link_id", "bold", "ital", "code")

    def differs(other: str, *names: str) -> Column:
        far = F.col(other)
        out = far.isNull()
        for name in names:
            out = out | (far[name] != F.col(name))
        return out

    def edges(other: str) -> list[Column]:
        return [
            F.col("link_id").__ge__(0) & differs(other, "link_id"),
            F.col("bold") & differs(other, "link_id", "bold"),
            F.col("ital") & differs(other, "link_id", "bold", "ital"),
            F.col("code") & differs(other, "link_id", "bold", "ital", "code"),
        ]

    def mark(flag: Column, text: Column | str) -> Column:
        return F.when(flag, text).otherwise("")

    start, end = edges("_prev"), edges("_next")
    blank = f"[{WS}]"
    core = F.regexp_replace("text", rf"\A{blank}+|{blank}+\z", "")
    piece = F.concat(
        F.when(F.col("text").rlike(rf"\A{blank}"), " ").otherwise(""),
        mark(start[0], "["), mark(start[1], "**"), mark(start[2], "*"), mark(start[3], "`"),
        core,
        mark(end[3], "`"), mark(end[2], "*"), mark(end[1], "**"),
        mark(end[0], F.concat(F.lit("]("), F.col("href"), F.lit(")"))),
        F.when(F.col("text").rlike(rf"{blank}\z"), " ").otherwise(""),
    )
    return (
        items.select("*", F.lag(state).over(run).alias("_prev"), F.lead(state).over(run).alias("_next"))
        .select("page_id", "block_no", "idx", "_keep", "at", F.when(F.col("solid"), piece).otherwise(F.col("text")).alias("piece"))
    )


def _blocks(items: DataFrame) -> DataFrame:
    grouped = items.groupBy("page_id", "block_no").agg(_listagg("piece", "idx").alias("_text"), F.min("at").alias("at"),
                                                  F.first("_keep", ignorenulls=True).alias("_keep"))
    flat = F.regexp_replace(collapse(F.col("_text")), rf"\A[ {_BR}]+|[ {_BR}]+\z", "")
    text = (
        F.when(F.col("at.in_pre"), F.regexp_replace("_text", rf"\A[\r\n]+|[{WS}]+\z", ""))
        .when(F.col("at.cell_id") >= 0, F.replace(F.trim(collapse(F.col("_text"))), F.lit("|"), F.lit("\\|")))
        .when(F.col("at.level") > 0, F.regexp_replace(flat, f" *{_BR}[ {_BR}]*", " "))
        .otherwise(F.regexp_replace(flat, f" *{_BR} *", "  \n"))
    )
    return (
        grouped.select("page_id", "block_no", "_keep", text.alias("text"), "at.*")
        .where("text <> '' OR cell_id >= 0 OR _keep IS NOT NULL")
    )


def _pages(blocks: DataFrame) -> DataFrame:
    on_page = Window.partitionBy("page_id").orderBy("block_no")
    item = Window.partitionBy("page_id", "li_id")
    row = Window.partitionBy("page_id", "row_id")
    table = Window.partitionBy("page_id", "table_id")
    here = F.struct("row_id", "table_id", "cell_id", "list_depth", "list_id", "quote_depth")
    is_cell = F.col("cell_id") >= 0
    blocks = blocks.select(
        "*",
        ((F.col("li_id") >= 0) & (F.col("block_no") == F.min("block_no").over(item))).alias("_first"),
        F.sum(is_cell.cast("int")).over(row).alias("_cells"),
        F.min(F.when(is_cell, F.col("row_id"))).over(table).alias("_top_row"),
    )
    blocks = blocks.select("*", F.lag(here).over(on_page).alias("_p"), F.lead(here).over(on_page).alias("_n"))

    def in_row(other: str) -> Column:
        return is_cell & F.coalesce((F.col(f"{other}.cell_id") >= 0) & (F.col(f"{other}.row_id") == F.col("row_id")), F.lit(False))

    in_table = is_cell & (F.col("_p.cell_id") >= 0) & (F.col("_p.table_id") == F.col("table_id"))
    in_list = F.col("_first") & (F.col("_p.list_depth") > 0) & ~(
        (F.col("list_depth") == 1) & (F.col("_p.list_depth") == 1) & (F.col("list_id") != F.col("_p.list_id"))
    )
    in_quote = (F.col("quote_depth") > 0) & (F.col("_p.quote_depth") > 0)
    quote = F.repeat(F.lit("> "), F.col("quote_depth").cast("int"))
    sep = (
        F.when(F.col("_p").isNull(), "")
        .when(in_row("_p"), " | ")
        .when(in_table | in_list, "\n")
        .when(in_quote, F.concat(
            F.lit("\n"), F.rtrim(F.repeat(F.lit("> "), F.least("quote_depth", "_p.quote_depth").cast("int"))), F.lit("\n")))
        .otherwise("\n\n")
    )
    marker = F.when(F.col("_first"), F.when(F.col("li_no") > 0, F.concat(F.col("li_no").cast("string"), F.lit(". "))).otherwise("- ")).otherwise("")
    steps = F.col("list_depth") - F.col("_first").cast("int")
    first_prefix = F.concat(quote, F.repeat(F.lit("    "), steps.cast("int")), marker)
    next_prefix = F.concat(quote, F.repeat(F.lit("    "), F.col("list_depth").cast("int")))
    body = (
        F.when(F.col("in_pre"), F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), F.col("text")))
        .otherwise(F.col("text"))
    )
    plain = F.concat(first_prefix, F.replace(body, F.lit("\n"), F.concat(F.lit("\n"), next_prefix)))
    rule_line = F.when(
        F.col("row_id") == F.col("_top_row"), F.concat(F.lit("\n"), quote, F.lit("|"), F.repeat(F.lit(" --- |"), F.col("_cells").cast("int")))
    ).otherwise("")
    cell = F.concat(
        F.when(in_row("_p"), "").otherwise(F.concat(quote, F.lit("| "))), F.col("text"),
        F.when(in_row("_n"), "").otherwise(F.concat(F.lit(" |"), rule_line)),
    )
    written = blocks.select("page_id", "block_no", "_keep", F.concat(sep, F.when(is_cell, cell).otherwise(plain)).alias("piece"))
    return written.groupBy("page_id").agg(
        F.first("_keep", ignorenulls=True).alias("_keep"),
        F.regexp_replace(_listagg("piece", "block_no"), rf"\A[{WS}]+|[{WS}]+\z", "").alias("markdown"),
    )
