"""SimHash balls, ranked search and token alignment beside their plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlweave.llm import ranking, simhash, tokens
from tests.llm import brute

ROWS = brute.awkward()
ITEMS = [(7, "Short Text ONE two"), (11, None), (3, ROWS[5][1] or "zz"), (12, "..."), (7, "Short Text ONE two"), (7, "emoji"), (None, "ab ab x")]
ITEMS += [(100 + i, r[1]) for i, r in enumerate(ROWS[:6])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("x"))


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_simhash_components(docs):
    out = simhash.component_report(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and ordered(out) == sorted(brute.simhash_components(ROWS), key=repr)


def test_fingerprints_in_pieces():
    text = "Ää b\tC d e  f\n" * 40 + "end"
    whole = [h.tobytes() for h in simhash.shingle_hashes(text.encode())]
    cut = [h.tobytes() for h in simhash.shingle_hashes(text.encode(), piece=9)]
    assert b"".join(whole) == b"".join(cut) and len(cut) > 20
    for t in (b"", None, b" \n", b"a", b"A b", b"a\nb c"):
        votes = simhash._Votes(1)
        for h in simhash.shingle_hashes(t, piece=1):
            votes.add(0, h)
        assert int(votes.fingerprints()[0]) % (1 << 64) == brute.simhash(t and t.decode())


def test_all_links_at_every_place_of_the_bits(spark):
    """Groups around random centres, with bits in one block and in several, at distances up to four."""
    rnd = random.Random(2)
    fps = set()
    for _ in range(60):
        centre = rnd.getrandbits(64)
        fps.add(centre)
        for _ in range(12):
            block = rnd.randrange(4)
            bits = rnd.sample(range(16 * block, 16 * block + 16) if rnd.random() < 0.5 else range(64), rnd.choice([1, 2, 3, 3, 4]))
            fps.add(centre ^ sum(1 << b for b in bits))
    fps |= {0, (1 << 64) - 1, 7, 1 << 63}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint").repartition(4)
    found = {r["fp"] % (1 << 64): r["root"] for r in simhash.fingerprint_components(df).collect()}
    wanted, by_root = brute.linked_fingerprints(fps), defaultdict(set)
    for x, root in found.items():
        by_root[root].add(x)
    by_wanted = defaultdict(set)
    for x, root in wanted.items():
        by_wanted[root].add(x)
    assert set(found) == fps and sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_wanted.values()))


def test_one_document_of_each_component_stays(docs):
    stay = {c for _, _, c in brute.simhash_components(ROWS)}
    assert {r[0] for r in simhash.one_per_component(docs).collect()} == stay


@pytest.mark.parametrize("max_terms", [ranking.MAX_TERMS, 300])
def test_ranks(docs, items, max_terms):
    out = ranking.ranked(docs, items, max_terms=max_terms)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(out) == sorted(brute.ranks(ROWS, ITEMS), key=repr)


def test_small_segments_give_the_same_ranks(docs, items, monkeypatch):
    monkeypatch.setattr(ranking, "SEGMENT_ROWS", 5)
    assert ordered(ranking.ranked(docs, items, top=3)) == sorted(brute.ranks(ROWS, ITEMS, 3), key=repr)


def segment(n, kinds, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        terms = [t for t in range(kinds) if rnd.random() < 0.9 / (1 + t)]
        rows.append((i // 2, rnd.randint(1, 60), terms, [rnd.choice([1, 1, 2, 9]) for _ in terms]))
    table = pa.table({"doc_id": [r[0] for r in rows], "n": [r[1] for r in rows], "terms": pa.array([r[2] for r in rows], pa.list_(pa.int32())), "tfs": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})
    return rows, ranking.Segment(table, n, sum(r[1] for r in rows))


@pytest.mark.parametrize("short", [0, 0.1, 1])
def test_search_of_a_segment(short):
    """Only accumulators, none, or both: the scores are those of all documents, and lists are skipped through."""
    rows, index = segment(3000, 40, 4)
    big_l = sum(r[1] for r in rows)
    for query in ([(0, 3), (1, 9), (2, 10), (7, 400), (39, 900)], [(0, 1)], [(38, 5), (99, 4)], [(t, 41 - t) for t in range(40)], [(0, 0)]):
        scores = [sum(w * (10**9 * f // (1000 * f + 12 * (75 + 25 * n * len(rows) // big_l))) for t, f in zip(terms, tfs) for q, w in query if q == t) for _, n, terms, tfs in rows]
        wanted = sorted(((-s, i) for i, s in enumerate(scores) if s > 0))[:20]
        places, found = index.search(query, 20, short, 64)
        assert [int(s) for s in found] == [-s for s, _ in wanted] and [int(p) for p in places] == [i for _, i in wanted]


def test_large_sums_stay_exact():
    table = pa.table({"doc_id": [1, 2], "n": [1 << 40, 3], "terms": pa.array([[0], [0]], pa.list_(pa.int32())), "tfs": pa.array([[5], [1]], pa.list_(pa.int64()))})
    index = ranking.Segment(table, 1 << 30, 1 << 41)
    assert index.adds.tolist() == [10**9 * 5 // (5000 + 12 * (75 + 25 * (1 << 40) * (1 << 30) // (1 << 41))), 10**9 // (1000 + 12 * 75)]


@pytest.fixture(scope="module")
def aligner():
    return tokens.Aligner(tokens.BYTE_BPE, tokens.PIECES)


STRANGE = [
    "a▁b", "héllo 😀 wörld \U0001f9ff\U0001f9ff x", "  lead", "trail  ", "a  b\n\n c", "<|endoftext|> <s> </s> <unk> x", "\x00 a", "x" * 3000, "好 好的世界", "á b  c　d e f",
    " ", "\n", "it's we'll 1234 12 3", "a  b", "é ́ x", "<0x41> <0xFF>", "\t\ttab \t x", "word.\nNext, word", "ﬁ ① ½",
]


def plain(aligner, texts):
    return brute.aligned(texts, aligner.a, aligner.bytes_a, aligner.b, aligner.bytes_b)


def test_units_align_as_whole_texts(aligner, monkeypatch):
    texts = STRANGE + [r[1] for r in ROWS]
    found, wanted = aligner.texts(texts), plain(aligner, texts)
    monkeypatch.setattr(tokens, "RUN", 40)
    pieces = tokens.Aligner(tokens.BYTE_BPE, tokens.PIECES).texts(texts)
    whole = tokens.Aligner(tokens.BYTE_BPE, tokens.PIECES)
    assert aligner.cuts
    whole.cuts = False
    for text, *others, w in zip(texts, found, pieces, whole.texts(texts), wanted, strict=True):
        for f in others:
            assert (f is None) == (w is None), text
            if w:
                n_a, n_b, groups, links, ends = w
                assert f[:4] == (n_a, n_b, len(groups), len(links)) and f[7] == ";".join(groups) and f[8].tolist() == ends
                assert f[4] == hashlib.sha256(f[7].encode()).hexdigest()
                assert dict(zip(f[5].tolist(), f[6].tolist(), strict=True)) == Counter((a << 32) + b for a, b in links)
    assert wanted[0] is None and sum(w is None for w in wanted) < 8


def test_units_with_white_space_at_an_end_are_not_joined_with_others():
    texts = [f"{before}w{k}{behind}" for k, (before, behind) in enumerate([("", "  "), ("  ", ""), ("", "\n"), ("\t ", " "), ("", "\u3000")] * 4)] + [" ", "  ", "\n ", "好", "🧿", "12", "word"]
    own = tokens.Aligner(tokens.BYTE_BPE, tokens.PIECES)
    for found, w in zip(own.texts(texts), plain(own, texts), strict=True):
        n_a, n_b, groups, links, ends = w
        assert found[:4] == (n_a, n_b, len(groups), len(links)) and found[7] == ";".join(groups) and found[8].tolist() == ends


def test_spans_inside_characters_are_refined(aligner):
    run = " 😀é\U0001f9ff"
    a, ends_a, b, ends_b = aligner.spans(run)
    assert len(a) > 4 and np.array_equal(ends_a, np.cumsum(aligner.length_a[a])) and np.array_equal(ends_b, np.cumsum(aligner.length_b[b]))
    assert any(e not in {1, 5, 7, 11} for e in ends_a.tolist())


def test_cache_keeps_its_bound(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    own = tokens.Aligner(tokens.BYTE_BPE, tokens.PIECES)
    for k in range(6):
        own.texts([" ".join(f"w{k}x{i}" for i in range(30)) + " " + "y" * 100])
        assert len(own.young) <= 60 and len(own.old) <= 60 and not any(len(u) > tokens.LONGEST_KEPT for u in own.young)


@pytest.mark.parametrize("max_pairs", [tokens.MAX_PAIRS, 400])
def test_alignment_report(spark, aligner, max_pairs):
    rows = ROWS + [(1000 + i, t, "en", "s", 1, "x", "y", 1) for i, t in enumerate(STRANGE)]
    out = tokens.alignment_report(spark.createDataFrame(rows, brute.SCHEMA).repartition(3), max_pairs=max_pairs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    wanted, texts = [], plain(aligner, [r[1] for r in rows])
    count = Counter(pair for w in texts if w for pair in set(w[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for r, w in zip(rows, texts, strict=True):
        if w:
            n_a, n_b, groups, links, _ = w
            wanted.append((r[0], n_a, n_b, len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        else:
            wanted.append((r[0], 0, 0, 0, 0, 0, 0, ""))
    assert ordered(out) == sorted(wanted, key=repr)


def test_alignments_give_groups_and_their_ends(docs, aligner):
    rows = {r["doc_id"]: r for r in tokens.alignments(docs).where("n_a > 0").collect()}
    for r, w in zip(ROWS, plain(aligner, [r[1] for r in ROWS]), strict=True):
        if w:
            assert rows[r[0]]["groups"] == ";".join(w[2]) and rows[r[0]]["group_ends"] == w[4]


def test_empty_tables(none, docs, items):
    assert simhash.component_report(none).collect() == [] and tokens.alignment_report(none).collect() == []
    assert ranking.ranked(none, items).collect() == [] and ranking.ranked(docs, items.limit(0)).collect() == []


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "x y z w"), ("a", "x y z w"), (None, None), ("c", "")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "w z")], "item_id string, text string")
    assert ordered(simhash.component_report(docs).drop("fingerprint")) == [("a", "a"), ("b", "a"), ("c", "c"), (None, "c")]
    score = 2 * 182 * (10**9 // (1000 + 12 * 100))
    assert ordered(ranking.ranked(docs, items)) == [("i", 1, "a", score), ("i", 2, "b", score)]
    assert {r["doc_id"]: r["n_a"] for r in tokens.alignment_report(docs).collect()} == {"a": 4, "b": 4, "c": 0, None: 0}
