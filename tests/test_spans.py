"""Tokens in linear time and balanced elements, beside plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from crawlweave.functions import html as H
from crawlweave.operators import extract, spans


def plain(text, names=("nav", "aside", "footer")):
    """Each name's ends close its latest open start; what a closed pair encloses goes."""
    out, open_at, gone, at = [], {n: [] for n in names}, set(), 0
    for i, m in enumerate(re.finditer(rf"(?i)</?({'|'.join(names)})(?:[ \t\r\n\f/][^>]*)?>", text)):
        out.append(text[at : m.start()])
        at, starts = m.end(), open_at[m[1].lower()]
        if m[0].startswith("</"):
            if starts:
                gone.update(range(starts.pop(), i + 1))
        elif not m[0].endswith("/>"):
            starts.append(i + 1)
    return "".join(g for i, g in enumerate([*out, text[at:]]) if i not in gone)


def test_elements_by_depth(spark):
    rnd = random.Random(1)
    pool = ["<aside>", "</aside>", "<NAV class=x>", "</nav>", "<footer/>", "<footer>", "</footer >", "a", "b ", "<p>", "\n", "<aside x", "<navy>", "</asides>"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.choice([5, 20, 60, 300]))) for _ in range(200)] + ["", "<nav>", "</nav>x", None]
    texts += ["<aside>" * n + "x" + "</aside>y" * m for n, m in ((70, 80), (200, 150), (65, 65), (64, 63))]
    rows = spans.without_elements(spark.createDataFrame([(t,) for t in texts], "h string").repartition(3), "h", "x").collect()
    assert len(rows) == len(texts) and all(r.x == (None if r.h is None else plain(r.h)) for r in rows)


@pytest.mark.parametrize("values", [[], [3], list(range(40, 0, -1)), [random.Random(5).randint(-9, 9) for _ in range(5000)]])
def test_running_folds(spark, values):
    df = spark.createDataFrame([(values, 1), (None, 2)], "v array<int>, n int")
    out = spans.with_running(spans.with_running(df, "v", "s", lambda a, b: a + b), "v", "low", lambda a, b: F.when(a.isNotNull(), F.least(a, b))).orderBy("n").collect()
    sums, lows = [], []
    for v in values:
        sums.append(v + (sums[-1] if sums else 0))
        lows.append(min(v, lows[-1]) if lows else v)
    assert out[0].s == sums and out[0].low == lows and out[1].s is None


WORDS = "Words of the article that are long enough to be kept as its text by every rule there is. " * 3


@pytest.mark.parametrize("body,content", [
    (f"<article><p>{WORDS}</p><aside>a<aside>b</aside>ccc</aside><p>end</p></article>", f"<p>{WORDS}</p><p>end</p>"),
    (f"<article><nav><nav>x</nav>y</nav>{WORDS}<footer><nav>z</nav>f</footer></article>", WORDS),
    (f"<article><aside>{WORDS}<aside>b</aside> tail</article>", f"{WORDS} tail"),
    (f"<article>{WORDS}</aside> more<article>inner</article> last</article>", f"{WORDS} more<article>inner</article> last"),
    (f"<main><aside/>{WORDS}</main>", WORDS),
])
def test_nested_chrome(spark, body, content):
    page = f"<html><body><nav>top<nav>sub</nav>menu</nav>{body}</body></html>"
    assert extract.main_region(spark.createDataFrame([(1, page)], "page_id bigint, html string")).first().content == content


def test_tokens_are_those_of_the_pattern(spark):
    rnd = random.Random(1)
    pool = ["<a b", "<", "'", '"', ">", "<p>", "x ", "</a>", "<!d", "<?p", "\n", '<a t="x>y">', "é😀", " > "]
    df = spark.createDataFrame([("".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25))),) for _ in range(2000)] + [("",), (None,)], "h string")
    pairs = df.select("h", H.tokens(F.col("h")).alias("a"), F.regexp_extract_all("h", F.lit(H.TOKEN), F.lit(0)).alias("b"))
    assert pairs.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


@pytest.mark.parametrize("piece", ["<a b", '<a "', "<a '>", "<a \"'>", "<nav ", "< x"])
def test_a_megabyte_of_broken_tags(spark, piece):
    df = spark.createDataFrame([(1, piece * ((1 << 20) // len(piece)))], "page_id bigint, html string")
    started = time.time()
    out = df.select(H.tokens(F.col("html")).alias("t")).select(F.size("t").alias("n"), F.length(F.array_join("t", "")).alias("size")).first()
    bare = spans.without_elements(df, "html", "x").select(F.length("x").alias("n")).first().n
    assert out.n > 1000 and out["size"] == bare == len(piece) * ((1 << 20) // len(piece)) and time.time() - started < 30  # hours if quadratic
