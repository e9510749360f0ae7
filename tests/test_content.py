import pytest
from pyspark.sql import functions as F

from crawlweave.functions.html import decode_entities
from crawlweave.operators import extract, images, output
from crawlweave.operators.markdown import to_markdown


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"https://example.com/dir/p{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_article(spark):
    html = """<html lang=en><head><title> Harbour  notes </title></head><body><div>menu</div><article><h1>Low tide</h1>
<p>The ferry waits until <b>noon</b>.</p><img alt="pier" src="/pics/pier.webp?w=9"><p>Then it leaves.</p></article></body></html>"""
    row = extract.extract_pages(pages(spark, html)).first()
    assert (row.title, row.source_rule, row.error_code) == ("Harbour notes", "article", None)
    assert row.markdown == "# Low tide\n\nThe ferry waits until **noon**.\n\n![pier](/pics/pier.webp?w=9)\n\nThen it leaves."
    assert [tuple(i) for i in row.images] == [("/pics/pier.webp?w=9", "pier", "pier.webp")]


LONG = "word " * 60
PROBES = {  # page -> markdown
    # a short block before a long one is kept as its heading
    f"<article>teaser</article><p>{LONG}</p>": "teaser\n\n" + LONG.strip(),
    f"<article>x</article><div>{LONG}{LONG}</div>": "x\n\n" + (LONG + LONG).strip(),
    f"<main>x</main><p>{LONG}</p>": "x\n\n" + LONG.strip(),
    '<p>a</p><svg class="i"/><p>body after icon</p>': "a\n\nbody after icon",
    "<p>a</p><svg><path d='M0'/></svg><p>b</p>": "a\n\nb",
    "<p>a</p><svg><p>still here": "a\n\nstill here",
    "<p>a</p><template><p>shown all the same": "a\n\nshown all the same",
    "<p>a</p><script>var x = '<p>gone'": "a",
    "<article><h1>Head</h1><aside>note<p>text behind</article>": "# Head\n\nnote\n\ntext behind",
    "<p " + " ".join(f'a{i}="{i}"' for i in range(150)) + ' title="x > y">text</p>': "text",
    "<p " + " ".join(f"d{i}='>'" for i in range(5000)) + ">much</p>": "much",
    "<p>&#00000065;&#x0000041;&#x110000;&#99999999999999999999;</p>": "AA\ufffd\ufffd",
}


def test_text_is_not_lost(spark):
    rows = extract.extract_pages(pages(spark, *PROBES)).orderBy("page_id").collect()
    assert [r.markdown for r in rows] == list(PROBES.values())


def test_regions(spark):
    long = "word " * 60
    cases = [
        "<title>Tide</title><body class=x><p>Nothing here is marked as the text.</p>",
        "<html><head><title>t</title></head><body> </body></html>",
        f"<body><nav><a href='/'>x</a></nav><main><p>{long}</p></main><footer>f</footer></body>",
        f"<body><div class=ad>Buy now</div><div>Read on</div><div><p>{long}</p><p>{long}</p></div><div><a href='/1'>one</a> <a href='/2'>two</a></div></body>",
        f"<article><nav>crumbs</nav><p>{long}</article>",
        f"<article><!-- <article> --><p>a</p></article><p>between</p><article><p>b</p></article>",
        "plain text only",
        "<article><script>var b = '<i>code</i>'</script> \n</article><body><p>the body</p></body>",
    ]
    rows = extract.main_region(pages(spark, *cases)).orderBy("page_id").collect()
    assert [r.source_rule for r in rows] == ["body", "body", "main", "blocks", "article", "article", "body", "body"]
    assert [r.error_code for r in rows] == [None, "no_content"] + [None] * 6
    assert "Buy now" not in rows[3].content and "one" not in rows[3].content and rows[3].content.count(long) == 2
    assert "crumbs" not in rows[4].content and "between" in rows[5].content
    assert rows[6].content == "plain text only" and rows[7].content == "<p>the body</p>"


def test_pages_over_the_limit_are_left_alone(spark):
    row = extract.extract_pages(pages(spark, "<article>" + "x" * 100 + "</article>"), max_bytes=50).first()
    assert (row.error_code, row.markdown, row.content) == ("content_too_large", "", "")
    assert extract.extract_pages(pages(spark, "<p>" + "x" * 47), max_bytes=50).first().error_code is None


MARKDOWN = {
    "<h1>Hello  <b>World</b></h1><h3>a\nb<br>c</h3>": "# Hello **World**\n\n### a b c",
    "<p>one<b>two </b>three <i>four</i></p>": "one**two** three *four*",
    "<b>bold <i>both</i></b> plain": "**bold *both*** plain",
    "<p><b>unclosed<p>next": "**unclosed**\n\nnext",
    '<a href="/x?a=1&amp;b=2">a <em>link</em></a><a>no</a><a href="">none</a>': "[a *link*](/x?a=1&b=2)nonone",
    "a<br>b<br><br>": "a  \nb",
    "<ul><li>one</li><li>two<ol><li>n1<li>n2</ol></li><li><p>three</p><p>more</p></li></ul>":
        "- one\n- two\n    1. n1\n    2. n2\n- three\n\n    more",
    "<ul><li>a</ul><ol><li>b</ol>": "- a\n\n1. b",
    "<blockquote><p>q1</p><blockquote>q2</blockquote></blockquote>end": "> q1\n>\n> > q2\n\nend",
    "<pre><code>if a &lt; b:\n    x</code>\n</pre><p>t</p>": "```\nif a < b:\n    x\n```\n\nt",
    "<ul><li>do<pre>a\n b</pre></ul>": "- do\n\n    ```\n    a\n     b\n    ```",
    "use <code>f(x)</code> <kbd>k</kbd>": "use `f(x) k`",
    "<table><tr><th>a<th>b<tr><td>1<td><p>x|y</p><p>z</p></tr><tr><td><td>2</table>after":
        "| a | b |\n| --- | --- |\n| 1 | x\\|y z |\n|  | 2 |\n\nafter",
    "a<hr>b": "a\n\n---\n\nb",
    '<p title="a > b">q</p></div></ul></pre>r': "q\n\nr",
    "1 < 2 &amp; 3 > 2": "1 < 2 & 3 > 2",
    "": "",
    " <p> </p> ": "",
}


def test_markdown(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(MARKDOWN)], "page_id long, content string")
    got = [r.markdown for r in to_markdown(df).orderBy("page_id").collect()]
    assert dict(zip(MARKDOWN, got)) == MARKDOWN


def test_tokens_give_the_page_again(spark):
    htmls = ['<p a="1>2" b=\'<x>\'>t<b</p><', "<a title=it's>x</a>", "x<!doctype y><?php z?>&amp;<", "<>< p></ p>"]
    from crawlweave.functions.html import tokens

    rows = pages(spark, *htmls).orderBy("page_id").select(F.array_join(tokens(F.col("html")), "").alias("t")).collect()
    assert [r.t for r in rows] == htmls


def test_entities(column):
    cases = {"&amp;lt; &lt;": "&lt; <", "&#8364;&#x1F600;": "€😀", "&#38;lt;": "&lt;", "&unknown; & &copy;": "&unknown; & ©",
             "&#xD800;&#0;&#9999999;": "���", "none": "none",
             "&Eacute;&alpha;&copy &NotEqualTilde; &;": "Éα&copy ≂̸ &;"}
    assert dict(zip(cases, column(list(cases), decode_entities))) == cases


def test_markdown_of_landed_pages_holds_no_tags(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    done = extract.extract_pages(df)
    assert done.where("markdown rlike '</?(p|b|h1|div|br|article)>' or markdown = ''").count() == 0
    assert done.count() == df.count()


def test_blocks_and_boilerplate(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away over many green hills today"
    html = f"<body><ul><li><a href=/>Home page</a><li>Log <a href=/x>in now</a></ul><p>{text} {text}</p><p>{text}</p><div>Share this</div></body>"
    blocks = extract.content_blocks(extract.page_blocks(extract.page_tokens(pages(spark, html)))).orderBy("block_no").collect()
    assert [(b.n_words, b.n_link_words, b.is_content) for b in blocks] == [(2, 2, False), (3, 2, False), (36, 0, True), (18, 0, True), (2, 0, True)]
    rows = [(f"h{p % 2}", p, n, t) for p in range(6) for n, t in enumerate(["Same footer", f"text {p}"])] + [("h0", 0, 9, "text 2")]
    kept = extract.host_boilerplate(spark.createDataFrame(rows, "host string, page_id long, block_no int, text string"), 3, 100).collect()
    assert sorted(r.text for r in kept) == sorted([f"text {p}" for p in range(6)] + ["text 2"])


def test_blocks_of_thousands_of_words(spark):
    html = f"<p>{'word ' * 3000}</p><p><a href=/>{'link ' * 2500}</a></p><p>{'after ' * 17}</p><p>{'end ' * 41}</p>"
    blocks = extract.content_blocks(extract.page_blocks(extract.page_tokens(pages(spark, html)))).orderBy("block_no").collect()
    assert [(b.n_words, b.n_link_words, b.is_content) for b in blocks] == [(3000, 0, True), (2500, 2500, False), (17, 0, True), (41, 0, True)]


def test_image_addresses(spark):
    df = spark.createDataFrame([(r, "https://example.com/dir/page?x=1") for r in
                                ["https://o.org/a.png", "/top.webp", "near.webp", "./a/b.png", "//cdn.x/y.gif", "?v=2", "data:image/png;base64,A", "../up.png", "a/../../../b.png?x=../y", "/a/./b/..", "#f"]],
                               "src string, url string")
    assert [r.image_url for r in images.resolve_image_urls(df).collect()] == [
        "https://o.org/a.png", "https://example.com/top.webp", "https://example.com/dir/near.webp", "https://example.com/dir/a/b.png",
        "https://cdn.x/y.gif", "https://example.com/dir/page?v=2", "https://example.com/up.png", "https://example.com/b.png?x=../y",
        "https://example.com/a/", "https://example.com/dir/page?x=1#f"]
    assert images.resolve_image_urls(spark.createDataFrame([("img.jpg", "")], "src string, url string")).count() == 0


def test_fit_and_strip(spark):
    meta = spark.createDataFrame([(1, 0, "a", 100, 100), (1, 1, "b", 2000, 50), (2, 0, "c", 10, 10), (1, 2, "d", None, None), (1, 3, "e", 3, 9000)],
                                 "page_id long, idx int, src string, width int, height int")
    fit = {r.src: (r.fit_width, r.fit_height) for r in images.fit_dimensions(meta, 50, 50).collect()}
    assert fit == {"a": (50, 50), "b": (50, 1), "c": (10, 10), "d": (None, None), "e": (1, 50)}
    strip = images.strip_layout(meta.where("idx < 3")).where("page_id = 1").orderBy("position").collect()
    assert [(r.src, r.width, r.height, r.x_offset, r.y_offset) for r in strip] == [
        ("merged", 2000, 150, 0, 0), ("a", 100, 100, 950, 0), ("b", 2000, 50, 0, 100), ("d", None, None, None, None)]
    assert strip[0].alt == "Merged 2 images"
    assert images.strip_layout(meta, "individual").count() == 5


def test_names(spark):
    df = spark.createDataFrame([("test.png", "u", "image/png", 0), ("", "http://h/x/image.png", "image/jpeg", 1), ("../../etc/passwd", "u", None, 2),
                                ("", "http://h/", "x", 3)], "filename string, image_url string, mime string, idx int")
    assert [r.safe_name for r in images.safe_filename(df).collect()] == ["test_0.png", "image_1.jpg", "______etc_passwd_2.jpg", "h_3.jpg"]


def test_base64(spark):
    df = spark.createDataFrame([(bytearray(b"x" * 100),), (bytearray(b""),), (None,)], "data binary")
    a, b, c = [r.base64 for r in images.image_base64(df).collect()]
    assert "\n" not in a and len(a) == 136 and b == "" and c == ""


@pytest.mark.parametrize("start, length, text, left", [(0, 5, "hello", 6), (6, 5, "world", 0), (0, 100, "hello world", 0), (20, 5, "", 0), (3, 0, "lo world", 0)])
def test_paginate(spark, start, length, text, left):
    row = output.paginate(spark.createDataFrame([("hello world", start, length)], "content string, start_index int, max_length int")).first()
    assert (row.content, row.remaining_content) == (text, left)


def test_slices_add_up_and_count_letters(spark):
    text = "añ😀" * 50
    df = spark.createDataFrame([(1, text), (2, "")], "id int, content string")
    rows = output.all_slices(df, 7).where("id = 1").orderBy("slice_no").collect()
    assert "".join(r.slice for r in rows) == text and all(len(r.slice) == 7 for r in rows[:-1]) and rows[-1].remaining_content == 0
    assert [r.slice for r in output.all_slices(df, 7).where("id = 2").collect()] == [""]


@pytest.mark.parametrize("start, count, left", [(0, 3, 2), (3, 2, 0), (0, 10, 0), (5, 3, 0)])
def test_remaining_images(spark, start, count, left):
    got = spark.range(1).select(output.remaining_images(F.lit(5), F.lit(start), F.lit(count)).alias("n")).first().n
    assert got == left


def test_answer_text(spark):
    df = spark.createDataFrame([("T", "body", 3, 2), ("", "body", 0, 0)], "title string, content string, remaining_content int, remaining_images int")
    a, b = [r.response for r in output.format_results(df).collect()]
    assert a == ("# T\n\nbody\n\n[Content truncated. 3 characters remaining. Use start_index to continue.]"
                 "\n\n[2 more images available. Use imageStartIndex to continue.]")
    assert b == "body"
