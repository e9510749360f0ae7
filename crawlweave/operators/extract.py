"""From a landed page to its article: tokens, blocks, title, main region, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.html import (
    BLOCK_TAGS, WS, attribute, collapse, decode_entities, drop_hidden, is_blank, is_tag, open_end, tag_attrs,
    tag_name, tokens, word_count,
)
from crawlweave.functions.urls import filename_from_url
from crawlweave.operators.markdown import to_markdown
from crawlweave.operators.spans import without_elements
from crawlweave.options import DEFAULTS


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per tag or text: page_id, idx, kind, tag, attrs, text. No shuffle."""
    token = F.col("_token")
    return (
        pages.select("page_id", F.posexplode(tokens(drop_hidden(F.col("html")))).alias("idx", "_token"))
        .select(
            "page_id", "idx",
            F.when(~is_tag(token), F.when(token.rlike(r"\A<[!?]"), "decl").otherwise("text"))
            .when(token.startswith("</"), "close").otherwise("open").alias("kind"),
            F.when(is_tag(token), tag_name(token)).otherwise("").alias("tag"),
            F.when(is_tag(token), tag_attrs(token)).otherwise("").alias("attrs"),
            F.when(is_tag(token), "").otherwise(token).alias("text"),
        )
    )


def page_title(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", title_of(drop_hidden(F.col("html"))).alias("title"))


def title_of(clean: Column) -> Column:
    """Title of a page without its hidden parts."""
    found = F.regexp_extract(clean, rf"(?is)<title(?:[{WS}][^>]*)?>(.*?)</title", 1)
    return F.trim(collapse(decode_entities(found)))


def page_blocks(token_rows: DataFrame) -> DataFrame:
    """Blocks of text between block tags: words, words inside links, link density.

    One shuffle, on the page; a window partition is one page, whose size the byte limit bounds.
    """
    on_page = Window.partitionBy("page_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    link_step = F.when(F.col("tag") == "a", F.when(F.col("kind") == "open", 1).otherwise(-1)).otherwise(0)
    marked = (
        token_rows.withColumn("_break", F.col("tag").isin(*BLOCK_TAGS).cast("int"))
        .withColumn("_sum", F.sum(link_step).over(on_page))
        .withColumn("block_no", F.sum("_break").over(on_page))
        .withColumn("_in_link", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(on_page)) > 0)
        .where("kind = 'text'")
        .withColumn("_words", word_count(F.col("text")))
    )
    words = F.sum("_words").cast("int")
    link_words = F.sum(F.when(F.col("_in_link"), F.col("_words")).otherwise(0)).cast("int")
    return (
        marked.groupBy("page_id", "block_no")
        .agg(
            F.trim(collapse(decode_entities(F.expr("listagg(text, '') within group (order by idx)")))).alias("text"),
            words.alias("n_words"),
            link_words.alias("n_link_words"),
        )
        .where("n_words > 0")
        .withColumn("block_no", F.col("block_no").cast("int"))
        .withColumn("link_density", F.col("n_link_words") / F.col("n_words"))
    )


def _dense(link_words: Column, words: Column, millionths: int) -> Column:
    # long: a block of some thousand words has more millionths than an int holds
    return link_words.cast("bigint") * 1_000_000 > words.cast("bigint") * millionths


def content_rule(words: Column, link_words: Column, before: Column, before_links: Column, after: Column) -> Column:
    """Decision tree on words and link density of a block and its neighbours (Kohlschuetter,
    Fankhauser, Nejdl: Boilerplate Detection using Shallow Text Features, WSDM 2010)."""
    return (
        F.when(_dense(link_words, words, 333_333), False)
        .when(_dense(before_links, before, 555_556), (words > 40) | (after > 17))
        .otherwise((words > 16) | (after > 15) | (before > 4))
    )


def content_blocks(blocks: DataFrame) -> DataFrame:
    """Add ``is_content``: article text or template text."""
    on_page = Window.partitionBy("page_id").orderBy("block_no")
    words, links = F.col("n_words"), F.col("n_link_words")
    return blocks.withColumn(
        "is_content",
        content_rule(
            words, links,
            F.coalesce(F.lag("n_words").over(on_page), F.lit(0)),
            F.coalesce(F.lag("n_link_words").over(on_page), F.lit(0)),
            F.coalesce(F.lead("n_words").over(on_page), F.lit(0)),
        ),
    )


def host_boilerplate(blocks: DataFrame, min_pages: int, min_percent: int) -> DataFrame:
    """Drop blocks whose text stands on ``min_pages`` pages of a host and on ``min_percent`` of them.

    ``blocks`` has host, page_id, block_no, text. Texts meet as digests; both counts start with a
    map-side distinct, so a host or a text with most of the rows spreads over its pages.
    """
    marked = blocks.withColumn("_digest", F.sha2("text", 256))
    seen = marked.select("host", "_digest", "page_id").distinct()
    per_text = seen.groupBy("host", "_digest").agg(F.count(F.lit(1)).alias("_pages"))
    per_host = (
        marked.select("host", "page_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("_all"))
    )
    template = (
        per_text.where(F.col("_pages") >= min_pages)
        .join(per_host, "host")
        .where(F.col("_pages") * 100 >= F.col("_all") * min_percent)
        .select("host", "_digest")
    )
    return marked.join(template, ["host", "_digest"], "left_anti").select(*blocks.columns)


def _inner(html: Column, tag: str) -> Column:
    """Content of an element from its first start to its last end, or to the end of the page."""
    tail = F.regexp_extract(html, rf"(?is)<{tag}(?:[{WS}/][^>]*)?>(.*)\z", 1)
    return F.regexp_replace(tail, rf"(?is)\A(.*)</{tag}.*\z", "$1")


def _text_words(html: Column) -> Column:
    rest = open_end(html)  # no tag ends in it
    return word_count(F.concat(F.regexp_replace(F.left(html, F.length(html) - F.length(rest)), "<[^>]*>", " "), rest))


def _holds_the_text(html: Column, body: Column) -> Column:
    """An element marked as the article is believed if a third of the page's words are in it; a card beside the text isn't."""
    return ~is_blank(html) & (_text_words(html) * 3 >= _text_words(body))


def region_candidates(pages: DataFrame, cleaned: bool = False) -> DataFrame:
    """Add ``region`` and ``rule`` (article, main, body) by tags alone; ``html`` is dropped. No shuffle.

    Navigation, asides and footers are taken out of the page first, unless nothing else is in its body.
    """
    keep = [c for c in pages.columns if c != "html"]
    article, main, body = F.col("_article"), F.col("_main"), F.col("_body")
    # one select per step: each pattern runs once per page
    bare = without_elements(pages.select(*keep, (F.col("html") if cleaned else drop_hidden(F.col("html"))).alias("_clean")), "_clean", "_bare")
    return (
        bare.select(*keep, "_clean", _inner(F.col("_bare"), "article").alias("_article"), _inner(F.col("_bare"), "main").alias("_main"), _body(F.col("_bare")).alias("_body"))
        .select(
            *keep, "_clean", "_article", "_main", "_body",
            F.when(_holds_the_text(article, body), "article").when(_holds_the_text(main, body), "main").otherwise("body").alias("rule"),
        )
        .select(
            *keep, "rule",
            F.when(F.col("rule") == "article", article).when(F.col("rule") == "main", main)
            .when(is_blank(body), _body(F.col("_clean"))).otherwise(body).alias("region"),
        )
    )


def _body(html: Column) -> Column:
    no_head = F.regexp_replace(
        html,
        rf"(?is)<!doctype[^>]*>|</?html(?:[{WS}][^>]*)?>|<head(?:[{WS}][^>]*)?>.*?</head[^>]*>"
        rf"|<title(?:[{WS}][^>]*)?>.*?</title[^>]*>", "",
    )
    return F.when(html.rlike(rf"(?i)<body[{WS}/>]"), _inner(html, "body")).otherwise(no_head)


def main_region(pages: DataFrame, keep: tuple[str, ...] = (), cleaned: bool = False) -> DataFrame:
    """``page_id``, the columns to keep, ``content`` (cleaned HTML), ``source_rule`` and ``error_code``.

    Pages marked up with article or main are done by tags and go through as one row. Others are
    cut into blocks, and texts that look like template are taken out; if that leaves nothing,
    the whole body stays. One shuffle, on the page, of the picked region. ``cleaned``: html has no
    comments, scripts and styles left.
    """
    region = F.coalesce("region", F.lit(""))
    pieces = F.when(F.col("rule") == "body", tokens(region)).otherwise(F.array(region))
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(True))
    rows = (
        region_candidates(pages.select("page_id", "html", *keep), cleaned).repartition("page_id")
        .select("page_id", "rule", kept.alias("_keep"), F.posexplode(F.concat(F.array(F.lit("")), pieces)).alias("idx", "_raw"))
        .withColumn("_keep", F.when(F.col("idx") == 0, F.col("_keep")))
    )
    on_page = Window.partitionBy("page_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loose = F.col("rule") == "body"
    tag = F.when(loose & is_tag(F.col("_raw")), tag_name(F.col("_raw"))).otherwise("")
    link_step = F.when(F.col("_tag") == "a", F.when(F.col("_raw").startswith("</"), -1).otherwise(1)).otherwise(0)
    is_text = loose & ~is_tag(F.col("_raw")) & ~F.col("_raw").rlike(r"\A<[!?]")
    marked = (
        rows.withColumn("_tag", tag)
        .withColumn("_break", F.col("_tag").isin(*BLOCK_TAGS).cast("int"))
        .withColumn("_sum", F.sum(link_step).over(on_page))
        .withColumn("_block", F.sum("_break").over(on_page))
        .withColumn("_in_link", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(on_page)) > 0)
        .withColumn("_words", F.when(is_text, word_count(F.col("_raw"))).otherwise(0))
    )
    blocks = marked.groupBy("page_id", "_block").agg(
        F.first("rule").alias("rule"),
        F.first("_keep", ignorenulls=True).alias("_keep"),
        F.sum("_words").alias("_n"),
        F.sum(F.when(F.col("_in_link"), F.col("_words")).otherwise(0)).alias("_n_link"),
        F.expr("listagg(_raw, '') within group (order by idx)").alias("_html"),
        F.expr("listagg(case when _break = 1 then _raw end, '') within group (order by idx)").alias("_frame"),
    )
    among = Window.partitionBy("page_id", F.col("_n") > 0).orderBy("_block")
    judged = blocks.withColumn(
        "_good",
        F.when(F.col("_n") == 0, F.lit(None).cast("boolean")).otherwise(content_rule(
            F.col("_n"), F.col("_n_link"),
            F.coalesce(F.lag("_n").over(among), F.lit(0)), F.coalesce(F.lag("_n_link").over(among), F.lit(0)),
            F.coalesce(F.lead("_n").over(among), F.lit(0)),
        )),
    ).withColumn("_kept", F.when(F.coalesce("_good", F.lit(True)), F.col("_html")).otherwise(F.col("_frame")))
    picked = judged.groupBy("page_id").agg(
        F.first("rule").alias("rule"),
        F.first("_keep", ignorenulls=True).alias("_keep"),
        F.bool_or(F.coalesce("_good", F.lit(False))).alias("_any"),
        F.expr("listagg(_html, '') within group (order by _block)").alias("_whole"),
        F.expr("listagg(_kept, '') within group (order by _block)").alias("_some"),
    )
    by_blocks = (F.col("rule") == "body") & F.col("_any")
    content = F.coalesce(F.when(by_blocks, F.col("_some")).otherwise(F.col("_whole")), F.lit(""))
    return (
        picked.withColumn("content", content)
        .select(
            "page_id", *[F.col("_keep")[c].alias(c) for c in keep], "content",
            F.when(by_blocks, "blocks").otherwise(F.col("rule")).alias("source_rule"),
            F.when(is_blank(F.col("content")), "no_content").alias("error_code"),
        )
    )


def image_array(content: Column) -> Column:
    """Images with a source, in order, as an array of src, alt, filename."""
    tags = F.filter(tokens(content), lambda t: t.rlike(rf"(?i)\A<img[{WS}/>]"))
    found = F.transform(
        tags,
        lambda t: F.struct(
            attribute(tag_attrs(t), "src").alias("src"),
            F.coalesce(attribute(tag_attrs(t), "alt"), F.lit("")).alias("alt"),
        ),
    )
    present = F.filter(found, lambda i: i["src"].isNotNull())
    return F.transform(
        present, lambda i: F.struct(i["src"].alias("src"), i["alt"].alias("alt"), filename_from_url(i["src"]).alias("filename"))
    )


def image_refs(contents: DataFrame) -> DataFrame:
    """One row per image of the cleaned content: idx, src, alt, filename. No shuffle."""
    keep = [c for c in contents.columns if c not in ("content", "html")]
    return (
        contents.select(*keep, F.posexplode(image_array(F.col("content"))).alias("idx", "_img"))
        .select(*keep, "idx", "_img.src", "_img.alt", "_img.filename")
    )


def raw_content(requests: DataFrame, contents: DataFrame) -> DataFrame:
    """Cleaned HTML or markdown per request, with its content type. ``contents`` has content and markdown."""
    return requests.join(contents, "page_id").select(
        *requests.columns,
        F.when(F.col("raw"), F.col("content")).otherwise(F.col("markdown")).alias("content"),
        F.when(F.col("raw"), "raw").otherwise("markdown").alias("content_type"),
    )


def extract_pages(pages: DataFrame, max_bytes: int = DEFAULTS.max_html_bytes) -> DataFrame:
    """One row per page: url, title, content, markdown, images (array), source_rule, error_code.

    Pages over the byte limit are never cut up. One scan and one shuffle, on the page.
    """
    too_large = F.octet_length("html") > max_bytes
    sized = pages.select(
        "page_id", "url", F.when(~too_large, drop_hidden(F.col("html"))).alias("html"),
        F.coalesce(too_large, F.lit(False)).alias("too_large"),
    ).withColumn("title", F.coalesce(title_of(F.col("html")), F.lit("")))
    regions = main_region(sized, keep=("url", "title", "too_large"), cleaned=True)
    coded = regions.withColumn("images", image_array(F.col("content"))).withColumn(
        "error_code", F.when(F.col("too_large"), "content_too_large").otherwise(F.col("error_code"))
    ).drop("too_large")
    return to_markdown(coded, keep=("url", "title", "content", "images", "source_rule", "error_code"))
