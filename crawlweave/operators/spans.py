"""Elements of a page as balanced spans: where starts and ends of a name balance, by running sums over a row's tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions.html import CHROME, WS, open_end

#: Up to so many values are folded in one piece.
FEW = 64


def _folded(values: Column, kind: str, op) -> Column:
    step = lambda acc, x: F.concat(acc, F.array(F.coalesce(op(F.try_element_at(acc, F.lit(-1)), x), x)))
    return F.aggregate(values, F.expr(f"cast(array() as {kind})"), step)


def with_running(df: DataFrame, values: str, out: str, op, kind: str = "array<int>") -> DataFrame:
    """df with the running fold of an array by an associative op that is null where a side is null, in pieces of the root of its length.

    Appending copies an array, so a piece costs the square of its length; all of them together cost length * root.
    """
    n = F.size(values)
    size = F.greatest(F.lit(FEW), F.ceil(F.sqrt(n)).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.call_function("div", n - 1, size).cast("int")))
    last = F.transform("_pieces", lambda xs: F.try_element_at(xs, F.lit(-1)))
    carried = lambda xs, end: F.transform(xs, lambda x: F.coalesce(op(end, x), x))
    ends = F.concat(F.array(F.lit(None).cast(kind[6:-1])), _folded(last, kind, op))
    # one select per step: each value is worked out once
    return (
        df.select("*", size.alias("_size")).select("*", F.transform(starts, lambda i: _folded(F.slice(values, i * F.col("_size") + 1, F.col("_size")), kind, op)).alias("_pieces"))
        .select(*df.columns, F.flatten(F.zip_with("_pieces", F.slice(ends, 1, F.size("_pieces")), carried)).alias(out))
    )


def without_elements(df: DataFrame, html: str, out: str, names: tuple[str, ...] = tuple(CHROME)) -> DataFrame:
    """df with ``out``: the HTML without the elements of some names, each whole one from its start tag to the end tag that
    balances it, and without their other tags. No shuffle; linear in the text, tags times their root at most in the tags.

    An end tag without a start, and a start tag that is never balanced or closes itself, enclose nothing: what follows
    stays. A name's depth is the running sum of its starts and ends, not below zero; of the starts open at a place, as many
    as the smallest depth from there on are never balanced, so text is outside where both are equal for every name.
    """
    tag, kind, keep = rf"(?i)</?(?:{'|'.join(names)})(?:[{WS}/][^>]*)?>", "array<array<int>>", [c for c in df.columns if c != out]
    name = lambda t: F.lower(F.regexp_extract(t, r"\A</?([a-zA-Z]+)", 1))
    way = lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1)
    # a tag's step for each name, and so all that follows
    steps = lambda t: F.transform(F.array(*map(F.lit, names)), lambda n: F.when(name(t) == n, way(t)).otherwise(0))
    added = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    smaller = lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y))
    above = lambda sums, lows: F.zip_with(sums, lows, lambda x, low: x - F.least(F.lit(0), low))
    df = df.select(*keep, open_end(F.col(html)).alias("_rest")).select(*keep, "_rest", F.left(html, F.length(html) - F.length("_rest")).alias("_head"))
    df = df.select(*keep, "_rest", F.when(F.col("_head").rlike(tag), F.col("_head")).alias("_head"))
    df = df.select("*", F.transform(F.regexp_extract_all("_head", F.lit(tag), F.lit(0)), steps).alias("_steps"))
    df = with_running(df, "_steps", "_sums", added, kind)
    df = with_running(df, "_sums", "_lows", smaller, kind)
    df = df.select(*keep, "_rest", "_head", F.reverse(F.zip_with("_sums", "_lows", above)).alias("_depths"))
    df = with_running(df, "_depths", "_after", smaller, kind)
    outside = F.reverse(F.zip_with("_depths", "_after", lambda x, low: x == low))
    df = df.select(*keep, "_rest", "_head", outside.alias("_outside"), F.split("_head", tag, -1).alias("_gaps"))
    kept = F.zip_with(F.slice("_gaps", 2, F.size("_gaps")), "_outside", lambda gap, free: F.when(free, gap).otherwise(""))
    text = F.concat(F.get("_gaps", F.lit(0)), F.array_join(kept, ""), F.col("_rest"))
    return df.select(*keep, F.when(F.col("_head").isNull(), F.col(html)).otherwise(text).alias(out))
