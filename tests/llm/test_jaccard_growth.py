"""The Jaccard join of growing tables: unlike sets that share a shingle don't walk each other, and their blocks fall apart."""

import random

import numpy as np
import pytest

import corpus_pipeline
from crawlweave.llm import jaccard_trie
from tests.llm import brute


@pytest.fixture
def visited(monkeypatch):
    """How many nodes of tries were counted."""
    count, real = [0], np.count_nonzero

    def counted(values):
        count[0] += 1
        return real(values)

    monkeypatch.setattr(np, "count_nonzero", counted)
    return count


def test_unlike_sets_dont_walk_each_other(visited):
    rnd, common = random.Random(2), list(range(20))
    sets = [sorted(rnd.sample(common, 12)) + [100 + 40 * k + i for i in range(30)] + [100 + 40 * (k + 1)] for k in range(600)]
    sets += [s[:-1] + [100_000] for s in sets[:50]]
    links = jaccard_trie.trie_links([np.array(s, np.int64) for s in sets])
    assert sorted(links) == [(k, 600 + k) for k in range(50)]
    assert visited[0] < 20 * len(sets)


def test_copies_too_far_edited_are_no_burden(visited):
    rnd = random.Random(3)
    base = list(range(400))
    sets = []
    for k in range(400):
        lost = rnd.sample(base, 60 if k % 2 else rnd.randint(0, 20))  # of 400 values 44 may differ on each side
        sets.append(np.array(sorted(set(base) - set(lost)) + [1000 + 100 * k + i for i in range(len(lost))], np.int64))
    links = jaccard_trie.trie_links(sets)
    assert len(links) == 199 and all(a % 2 == b % 2 == 0 for a, b in links)
    assert visited[0] < 40 * len(sets)


@pytest.mark.parametrize("seed", range(4))
def test_links_with_known_groups(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        bases = [rnd.sample(range(60), rnd.randint(4, 25)) for _ in range(4)]
        sets = sorted({tuple(sorted(set(rnd.choice(bases)) ^ {rnd.randrange(60) for _ in range(rnd.randint(0, 4))})) for _ in range(30)} - {()}, key=lambda s: rnd.random())
        groups = [rnd.choice([rnd.randint(0, 4), 100 + k]) for k in range(len(sets))]
        known = [(groups.index(g), k) for k, g in enumerate(groups)]
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})]
        links = jaccard_trie.trie_links([np.array(s, np.int64) for s in sets], groups)

        def labels(edges):
            label = list(range(len(sets)))
            for a, b in edges:
                a, b = label[a], label[b]
                label = [min(a, b) if x in (a, b) else x for x in label]
            return label

        assert {(max(x), min(x)) for x in links} <= set(pairs) and labels(links + known) == labels(pairs + known)


def test_blocks_of_unlike_texts_fall_apart(spark, monkeypatch):
    """Each text shares five phrases with other texts: one block over single shingles, but no two of the texts link."""
    rnd = random.Random(5)
    phrases = 2 * [" ".join(f"p{k}w{i}" for i in range(10)) for k in range(300)]
    rnd.shuffle(phrases)
    rows = [(k, " ".join(phrases[5 * k : 5 * k + 5])) for k in range(120)]
    rows += [(1000 + k, text + " more") for k, text in rows[::9]]
    rows += [(2000, "a b c d e f g h"), (2001, "a b c d e f g h i"), (2002, "one two"), (2003, "one two"), (2004, None)]

    def never(*_):
        raise AssertionError("parts of a large block met")

    monkeypatch.setattr(jaccard_trie.shingle_components, "__defaults__", (jaccard_trie.SIZE, 1500))
    monkeypatch.setattr(jaccard_trie, "_between_parts", never)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_trie.component_report(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, brute.components(rows)))


@pytest.mark.parametrize("part", [60, 1500])
def test_large_blocks_keep_their_links(spark, monkeypatch, part):
    """Near copies in blocks that are split, and cut into parts where they stay too large."""
    rnd = random.Random(part)
    words = [f"w{k}" for k in range(12 * 40 + 40)]
    rows = []
    for k in range(40):
        for c in range(6):
            text = words[12 * k : 12 * k + rnd.choice((5, 8, 30))]
            for _ in range(rnd.choice((0, 1, 1, 2))):
                text[rnd.randrange(len(text)) if c % 2 else -1] = f"x{rnd.randrange(6)}"
            rows.append((10 * k + c, " ".join(text)))
    monkeypatch.setattr(jaccard_trie.shingle_components, "__defaults__", (jaccard_trie.SIZE, part))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard_trie.component_report(docs).collect())) == sorted(map(tuple, brute.components(rows)))


def test_pipeline_keeps_one_text_of_each_component(spark, monkeypatch):
    """Its second stage on texts that share phrases, most of them in one block over single shingles."""
    rnd = random.Random(7)
    phrases = 2 * [" ".join(f"p{k}w{i}" for i in range(10)) for k in range(300)]
    rnd.shuffle(phrases)
    rows = [(k, " ".join(phrases[5 * k : 5 * k + 5])) for k in range(120)]
    rows += [(1000 + k, text + " more") for k, text in rows[::9]] + [(2000, None), (2001, None)]
    monkeypatch.setattr(jaccard_trie.shingle_components, "__defaults__", (jaccard_trie.SIZE, 1500))
    monkeypatch.setattr(jaccard_trie, "_between_parts", lambda *args: pytest.fail("parts of a large block met"))
    kept = corpus_pipeline.join_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(120), 2000, 2001]
