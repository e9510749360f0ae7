"""Visible text of pages, compared with what a reader sees."""

import pytest

from crawlweave.llm import render

CASES = [
    (None, ""), ("", ""), ("plain", "plain"), ("<!-- x --><!doctype html>", ""), ("1 < 2 &amp; 3 > 2", "1 < 2 & 3 > 2"),
    ("<title>T</title><p>a", "a"), ("<head><style>p{}</style><body>a", "a"), ("<script>if (a < b) x('</p>')</script>t", "t"),
    ("<p>one<p>two", "one\n\ntwo"), ("a<div>b</div>c", "a\nb\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<b>a</b> <i> b</i>  c", "a b c"),
    ("x<span hidden>no</span>y<span style='color:red; DISPLAY : none'>no</span>", "xy"), ("<div style=\"visibility:hidden\">no</div>a", "a"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=3><li>a</li><li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<table><tr><th>Name<th>N<tr><td>apple pie<td>2</table>", "Name       N\napple pie  2"), ("<table><caption>c<tr><td>a<td>b<tr><td colspan=2>wide one<tr><td>cc<td>d</table>", "c\na   b\nwide one\ncc  d"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"), ("<table><tr><td>x<table><tr><td>in</table></table>after", "x\n\nin\n\nafter"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"), ("<details><summary>s</summary>no</details>a", "s\na"), ("<details open><summary>s</summary>yes</details>", "s\nyes"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<input type=hidden value=x><input value='seen'>", "seen"), ("</div></p>a</table>b", "ab"),
    ("<p title='a > b'>t</p>", "t"), ("<blockquote>q</blockquote>a", "  q\n\na"), ("&eacute;&#65;&#x42;&bogus;", "éAB&bogus;"), ("<svg><text>no</text></svg>a", "a"),
    ("<td>a<p>b</td>c", "a\n\nb\n\nc"), ("<textarea> k\n l</textarea>", " k\n l"), ("a<hr>b", "a\n\nb"), ("<p>a<!-- <p>no</p> -->b", "ab"), ("<b", "<b"), ("<p>text <", "text <"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_visible_text(page, text):
    assert render.visible_text(page) == text


def test_deep_nesting_keeps_text():
    assert render.visible_text("<div>" * 3000 + "deep" + "</div>" * 3000 + "end").split() == ["deep", "end"]
    assert render.visible_text("<ul><li>" * 500 + "x").strip(" -\n").endswith("x")


def test_long_page():
    page = "<p>" + "word " * 200_000 + "<p>" * 50_000 + "last"
    text = render.visible_text(page)
    assert text.startswith("word word") and text.endswith("last")


def test_report(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b", "x"), (1, "<p>a<p>b", "x"), (None, None, "x"), (3, "", "x")], "page_id bigint, html string, text string")
    rows = sorted(map(tuple, render.text_report(pages).collect()), key=repr)
    assert rows == sorted([(1, "a\n\nb", 4, 3), (1, "a\n\nb", 4, 3), (None, "", 0, 0), (3, "", 0, 0)], key=repr)
    assert render.text_report(pages.limit(0)).count() == 0
