"""Lines whose words have many entries: what the rounds find equals a comparison of all lines."""

import random
import time

import pytest

from crawlweave.llm import line_dedup
from tests.llm import brute


def crowd(n, seed):
    """Near copies of two lines, unlike lines that share their words, and copies; each word has most of the entries."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(24)]
    rows = []
    for d in range(n):
        base = words[:20] if d % 3 else words[4:]
        lines = [" ".join(rnd.sample(base, rnd.choice((9, 14, 18, 19, 20)))), "same line of all documents", ""]
        lines.append(" ".join(base[:-1] + [f"own{d % 40}"]))
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("few", [1, 4, 64])
def test_rounds_find_what_a_comparison_of_all_lines_finds(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rows = crowd(150, few)
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in got} == brute.lines_kept(rows)


def test_a_text_of_many_lines_takes_linear_time(spark):
    rows = [(1, "\n".join(f"a{k} b{k} c{k}" for k in range(80_000)) + "\n\na1 b1 c1"), (2, "a7 b7 c7\nother words"), (2, "x\ny\n\nz"), (3, "a7 b7 c7\nmore words")]
    # the two rows of document 2 share their line numbers: a line stays if that of the other row does
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    started = time.time()
    got = sorted((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.line_report(docs).collect())
    assert got == [(1, 80_002, 1), (2, 2, 0), (2, 4, 0), (3, 2, 1)]
    assert time.time() - started < 40


def test_unlike_lines_of_frequent_words_leave_the_index(spark, monkeypatch):
    """Each word stands in about ten lines, more than FEW, but no two lines are alike: few entries may be joined or written."""
    monkeypatch.setattr(line_dedup, "FEW", 2)
    real, written = line_dedup.staged, {}

    def counted(df, purpose, *more):
        out = real(df, purpose, *more)
        written[purpose] = written.get(purpose, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "staged", counted)
    rnd = random.Random(3)
    rows = [(d, " ".join(f"w{k}" for k in rnd.sample(range(2_000), 20))) for d in range(1_000)]
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 1_000 and all(r.n_removed == 0 for r in got)
    assert written.pop("classes") == 1_000 and sum(written.values()) < 1_000, written


def test_lines_at_the_limit_meet(spark):
    """Pairs of lines with the least overlap that resembles, or one word less, of sizes up to 60; pairs share no words."""
    rnd, rows, alike = random.Random(4), [], 0
    for p in range(400):
        n = rnd.randint(4, 60)
        m = rnd.randint(-(-4 * n // 5), n)
        both = -(-4 * (n + m) // 9)
        if both > m:
            continue
        less = rnd.random() < 0.2
        words = [f"p{p}w{k}" for k in range(n + m - both + less)]
        rnd.shuffle(words)
        pair = [words[:n], words[n - both + less :]]
        assert [len(set(x)) for x in pair] == [n, m]
        alike += not less
        for x in rnd.sample(pair, 2):
            rows.append((len(rows), " ".join(rnd.sample(x, len(x)))))
    # counts of their own for some words, so that the order isn't one of hashes alone
    some = sorted({w for _, line in rows for w in line.split()})
    rows += [(10_000 + k, f"{w} x{k} y{k} z{k} u{k} v{k}") for k, w in enumerate(rnd.choices(some, k=2_000))]
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in got} == brute.lines_kept(rows)
    assert alike > 200 and sum(r.n_removed for r in got) == alike
