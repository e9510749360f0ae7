"""Cases in which the operators once did less than the whole job."""

import base64
import random
from collections import Counter

from crawlweave.llm import language, mixing, rlbwt
from tests.llm import brute


def test_texts_that_the_model_never_learned_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rnd = random.Random(1)
    strange = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由，在尊严和权利上一律平等。",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", base64.b64encode(rnd.randbytes(600)).decode(),
        " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(200)), "12 ...",
    ]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(strange)], docs.schema)
    kept = language.with_known_language(docs.unionByName(more))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_known_share_of_a_word():
    model = {"langs": ["a", "b"], 0: {"known": [-1.0, -2.0]}, 4: {}, 3: {"xyz": [-1.0, -3.0]}, 2: {}, 1: {"z": [-1.0, -1.0]}}
    assert [language.judged_word(model, w)[1] for w in ("known", "wxyz", "z", "ww")] == [1.0, 0.25, 0.0, 0.0]
    assert language.judged(model, "known z ww ww", {})[2] == 0.25 and language.judged(model, "ww", {}) == ("a", 0.5, 0.0)


def test_a_repeated_row_keeps_its_first_occurrences(spark):
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(600))
    near = base[:300] + "#" + base[301:]
    rows = [(i, t, "en", "s", 1, "x", "y", 1) for i, t in ((1, base), (2, near), (2, near), (None, near[:450] + "!" + near[200:]), (None, near[:450] + "!" + near[200:]))]
    out = rlbwt.repeat_report(spark.createDataFrame(rows, brute.SCHEMA).repartition(3)).collect()
    assert len(out) == 5 and {r[0]: tuple(r)[1:] for r in out} == brute.bytes_removed(rows)


def test_blocks_are_dealt_to_shards(spark):
    docs = spark.createDataFrame(brute.awkward(), brute.SCHEMA).repartition(3)
    rows = mixing.mixed_blocks(docs, block=4, shards=8).collect()
    sizes, wanted = brute.targets(brute.awkward())
    slots = {r["source"]: r["slots"] for r in mixing.targets(mixing.sized(docs), 4).collect()}
    assert sorted(r["position"] for r in rows) == list(range(len(rows))) and len(rows) == sum(slots.values())
    assert all(r["shard"] == r["position"] * 8 // len(rows) and len(brute.GAP.findall(r["text"])) == r["n_words"] <= 4 for r in rows)
    words = Counter()
    for r in rows:
        words[r["source"]] += r["n_words"]
    assert all(abs(words[s] - t) <= 8 for s, t in wanted.items())
    # each shard's blocks of a source are a draw without replacement: within five deviations of its share
    for s, n in slots.items():
        for shard, size in Counter(r["shard"] for r in rows).items():
            mean, found = size * n / len(rows), sum(r["shard"] == shard and r["source"] == s for r in rows)
            assert abs(found - mean) <= 5 * (mean * (1 - n / len(rows))) ** 0.5 + 1
    # a source's blocks are its documents' words, and every use of a block has the same text
    texts = {}
    for r in rows:
        assert texts.setdefault((r["source"], r["block"]), r["text"]) == r["text"]
    given = Counter((x[3], w) for x in brute.awkward() for w in brute.GAP.findall(x[1] or ""))
    assert not Counter((s, w) for (s, _), t in texts.items() for w in brute.GAP.findall(t)) - given
    again = mixing.mixed_blocks(docs.repartition(5), block=4, shards=8).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    taken = sum(r["taken"] for r in mixing.mix_report(docs, block=4).collect())
    assert taken == sum(words.values())
