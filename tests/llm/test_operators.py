"""Each operator on awkward documents beside its plain version, and on an empty table."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from crawlweave.llm import anchors, decontaminate, hilbert, jaccard_trie, language, line_dedup, mixing, rlbwt, seed_extend, syncmers
from tests.llm import brute

ROWS = brute.awkward()
ITEMS = [(7, "Short Text ONE two"), (11, None), (3, ROWS[5][1] or "zz"), (12, "..."), (7, "Short Text ONE two")] + [(100 + i, r[1]) for i, r in enumerate(ROWS[:3])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def got(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def keyed(rows):
    return {r[0]: tuple(r[1:]) for r in rows}


@pytest.mark.parametrize("split", [rlbwt.SPLIT, 2])
def test_run_length_index(docs, split, monkeypatch):
    monkeypatch.setattr(rlbwt.repeats, "__defaults__", (rlbwt.WINDOW, rlbwt.SEED, split))
    rows = got(rlbwt.repeat_report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert len(rows) == len(ROWS) and keyed(rows) == brute.bytes_removed(ROWS)


def test_run_index_finds_the_earliest_occurrences():
    rnd = random.Random(3)
    base = bytes(rnd.choice(b"ab") for _ in range(60))
    parts = [base[i : i + rnd.randint(20, 40)] for i in range(0, 30, 3)] + [b"a" * 30, base[:25] + b"c" + base[26:50]]
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    index = rlbwt.RunIndex(data, window=10)
    assert index.lengths.sum() == len(data)
    places, first = index.earliest(data, starts, np.array([len(p) for p in parts]))
    raw = data.tobytes()
    assert len(places) == sum(len(p) - 9 for p in parts)
    for place, found in zip(places, first):
        assert found == raw.find(raw[place : place + 10])


def test_long_texts_are_cut_without_loss(monkeypatch):
    values = np.arange(400, dtype=np.uint64) % 37 + 1
    whole = [w.sum() for _, _, w, _, _ in anchors.stretches(values, np.array([0, 400]), 20, 5)]
    monkeypatch.setattr(anchors, "CHUNK", 50)
    cut = [w.sum() for _, _, w, _, _ in anchors.stretches(values, np.array([0, 400]), 20, 5)]
    assert sum(whole) == sum(cut) == 381 and len(cut) > 1


def test_seed_extend(docs):
    rows = got(seed_extend.repeat_report(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert len(rows) == len(ROWS) and keyed(rows) == brute.words_removed(ROWS)


def test_hilbert_shards(docs):
    rows = hilbert.sharded(docs).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    size = lambda t: len((t or "").encode())
    assert ordered((r[0], r[1], r[2]) for r in rows) == ordered((r[0], size(r[1]) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    carried = hilbert.sharded(docs, carry=True)
    assert carried.columns == [*docs.columns, "shard_", "slot"]
    assert ordered(tuple(r)[:-2] for r in carried.collect()) == ordered(ROWS)


def test_hilbert_curve_steps_to_a_neighbour(spark):
    from pyspark.sql import functions as F

    cells = spark.range(4096).select((F.col("id") % 16).cast("int").alias("x"), (F.col("id") / 16 % 16).cast("int").alias("y"), (F.col("id") / 256).cast("int").alias("z"))
    rows = hilbert.hilbert_index([F.col("x"), F.col("y"), F.col("z")], cells, "at").orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(4096))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("most", [decontaminate.MAX_PATTERNS, 40])
def test_decontamination(spark, docs, most):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    if most == decontaminate.MAX_PATTERNS:
        assert ordered(got(decontaminate.contamination_report(docs, items), *columns)) == ordered(brute.contamination(ROWS, ITEMS))
    else:  # several automata
        out, hits = decontaminate.benchmark_hits(docs, items, max_patterns=most)
        rows = [(r["doc_id"], len({w for x in r[hits]["ranges"] for w in range(x["low"], x["high"])}), len(r[hits]["items"])) for r in out.collect()]
        assert ordered(rows) == ordered((r[0], r[2], r[3]) for r in brute.contamination(ROWS, ITEMS))
    clean = decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r[5] for r in brute.contamination(ROWS, ITEMS))


def test_offsets_map_to_the_original():
    text = "É, Ab--c D9!"
    assert decontaminate.normal_words(text) == ["É".encode(), b"ab", b"c", b"d9"]
    data = text.encode()
    assert [data[a:b].decode() for a, b in decontaminate.original_ranges(text, [(0, 1), (1, 3), (3, 4)])] == ["É", "Ab--c", "D9"]


def test_mixing(docs):
    rows = mixing.mix_report(docs, block=4).collect()
    assert ordered(r["doc_id"] for r in rows) == ordered(r[0] for r in ROWS)
    sizes, wanted = brute.targets(ROWS)
    source = {(r[0], len(brute.GAP.findall(r[1] or ""))): r[3] for r in ROWS}
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - wanted[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= 8
    again = mixing.mix_report(docs.repartition(5), block=4).collect()
    assert ordered(map(tuple, rows)) == ordered(map(tuple, again))
    mixed = mixing.mixed(docs, block=4)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(brute.GAP.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == +taken


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 100):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), [F.lit("k")]).alias("x")).collect()
        assert sorted(r["x"] for r in rows) == list(range(n))


def test_closed_syncmers(docs, monkeypatch):
    rows = syncmers.fingerprint_report(docs).collect()
    assert len(rows) == len(ROWS)
    order = brute.by_id({(r[0], r[1]): r for r in ROWS}.values())
    texts = {r[0]: r[1] or "" for r in order}
    following = {a[0]: texts[b[0]] for a, b in zip(order, order[1:] + order[:1])}
    digits = lambda f: "".join(f"{v & 0xFFFFFFFF:08x}" for v in f)
    for r in rows:
        text, nxt = texts[r["doc_id"]], following[r["doc_id"]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        own, new, other = map(brute.fingerprint, (text, edited, nxt))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == brute.sha(edited.encode())
        assert r["fingerprint"] == digits(own) and r["edited_fingerprint"] == digits(new)
        assert abs(r["near_edited"] - brute.likeness(own, new)) < 1e-9 and abs(r["near_next"] - brute.likeness(own, other)) < 1e-9


def test_anchors_don_t_depend_on_pieces(spark, monkeypatch):
    from pyspark.sql import functions as F

    text = ROWS[9][1] or "abc " * 200
    df = spark.createDataFrame([("".join(random.Random(1).choice("abcd é") for _ in range(3000)),), (text,), ("",), ("abc",)], "text string")
    whole = df.select(syncmers.anchors(F.col("text"))).collect()
    monkeypatch.setattr(syncmers, "PIECE", 100)
    assert df.select(syncmers.anchors(F.col("text"))).collect() == whole


def test_language_of_awkward_texts(docs):
    rows = language.predictions(docs).collect()
    assert len(rows) == len(ROWS)
    letters = {(r[0], r[1]): any(c.isalpha() for c in r[1] or "") for r in ROWS}
    expected = Counter((i, has) for (i, _), has in letters.items())
    assert {(r["doc_id"], r["lang_pred"] != "und") for r in rows} == set(expected)
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["lang_pred"] != "und") for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in language.predictions(docs).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.98 * len(held) > 300


def test_backoff_goes_to_shorter_pieces():
    model = {"langs": ["a", "b"], 0: {"known": [-1.0, -2.0]}, 4: {}, 3: {"xyz": [-1.0, -3.0]}, 2: {"qq": [-3.0, -1.0]}, 1: {"z": [-1.0, -1.0]}}
    assert language.word_scores(model, "known") == [-1.0, -2.0]
    assert language.word_scores(model, "wxyz") == pytest.approx([-1.8, -3.8])
    assert language.word_scores(model, "qq") == pytest.approx([-4.2, -2.2])
    assert language.word_scores(model, "ww") is None
    assert language.predict_one(model, "12 !", {}) == ("und", 0.0) and language.predict_one(model, None, {}) == ("und", 0.0)
    assert language.predict_one(model, "known", {})[0] == "a" and language.predict_one(model, "z", {}) == ("a", 0.5)


@pytest.mark.parametrize("part", [jaccard_trie.PART, 400])
def test_jaccard_join(docs, part, monkeypatch):
    monkeypatch.setattr(jaccard_trie.shingle_components, "__defaults__", (jaccard_trie.SIZE, part))
    rows = got(jaccard_trie.component_report(docs), "doc_id", "n_shingles", "component_id")
    assert ordered(rows) == ordered(brute.components(ROWS))


def test_one_document_stays_of_each_component(docs):
    kept = jaccard_trie.one_per_component(docs)
    assert kept.columns == docs.columns
    found = brute.components(ROWS)
    expected = Counter(c for _, n, c in found if n) and {c for _, n, c in found if n}
    rows = kept.collect()
    with_words = [r for r in rows if brute.shingles(r["text"])]
    assert ordered(r["doc_id"] for r in with_words) == ordered(expected)
    assert len(rows) - len(with_words) == sum(n == 0 for _, n, _ in found)


def test_trie_links_connect_as_all_pairs_do():
    rnd = random.Random(1)
    for _ in range(150):
        bases = [sorted(rnd.sample(range(40), rnd.randint(3, 20))) for _ in range(4)]
        sets = set()
        for _ in range(25):
            s = set(rnd.choice(bases))
            for _ in range(rnd.randint(0, 3)):
                s ^= {rnd.randrange(40)}
            sets.add(tuple(sorted(s)))
        sets = [np.array(s, np.int64) for s in sets if s]
        pairs = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
        links = jaccard_trie.trie_links(sets)
        assert all((max(x), min(x)) in pairs for x in links)

        def labels(edges):
            parent = list(range(len(sets)))

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in edges:
                a, b = sorted((find(a), find(b)))
                parent[b] = a
            return [find(i) for i in range(len(sets))]

        assert labels(links) == labels(pairs)


def test_line_join(docs):
    rows = got(line_dedup.line_report(docs), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert len(rows) == len(ROWS) and keyed(rows) == brute.lines_kept(ROWS)


def test_empty_tables(spark, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for df in (
        rlbwt.repeat_report(none), seed_extend.repeat_report(none), hilbert.sharded(none), hilbert.sharded(none, carry=True), decontaminate.contamination_report(none, items),
        mixing.mix_report(none), mixing.mixed(none), syncmers.fingerprint_report(none), language.predictions(none), language.with_known_language(none),
        jaccard_trie.component_report(none), jaccard_trie.one_per_component(none), line_dedup.line_report(none),
    ):
        assert df.count() == 0


def test_empty_benchmark(spark, docs):
    assert decontaminate.decontaminated(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == len(ROWS)
