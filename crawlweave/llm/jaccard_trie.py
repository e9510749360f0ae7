"""N-gram Jaccard join: sets of 5-word shingles in a global order, joined over prefix trees.

1. Shingle frequencies are counted over all documents into a fixed table of `BUCKETS` counters, which tells the very common
   ones. A share `FRONT` of all other shingles, chosen by hash, is counted exactly. The global order of shingles is: those
   counted, rarest first; then all others by (count of the bucket, hash). It is the same everywhere.
2. Equal sets become one class. Two sets with Jaccard >= 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each, so
   classes that share no such prefix shingle, directly or over others, can't link: they fall into separate blocks. Sets
   that share one are chained by size, and a chain breaks where the next size is out of reach.
3. A block with more shingles than a task should hold is split: a link's sets also share two shingles that are neighbours
   in the order of both, among the first 0.4 n + 1 such pairs of each, and are chained over those.
4. In a block the sets, commonest shingle first, are put one by one into compressed tries, one or more for each component.
   Before a set goes in, it walks the tries of those other components that have one of its prefix shingles in a prefix: sets
   below a node share the overlap counted down to it, and a subtree is left when its size bounds or the overlap still
   possible rule a link out; the first link ends the walk. Shingles that no other set of the task has are in no trie.
5. A block that is still too large is cut into parts. Parts are joined alone, together with a few
   common sets of the block that tie them up; then every two parts which aren't wholly in one component meet once.

A link is dropped nowhere: only pairs already connected are skipped, so components are exact (equality of shingles is
that of 64-bit hashes). Defined results: null and wordless texts have no shingles and are alone; fewer than five words are
one shingle; equal rows are in one component; component_id ignores null doc_ids (null if there is no other); an empty
table gives an empty result. Only doc_id and text are read; other columns ride along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from crawlweave.llm.components import components
from crawlweave.llm.hashing import mix, signed, text_runs, windows, words_of
from crawlweave.llm.memory import released
from crawlweave.llm.staging import fresh, staged

SIZE = 5
#: Jaccard threshold as a fraction.
OVER, UNDER = 80, 100
BUCKETS = 1 << 18
#: Share of shingles counted exactly: more than the fifth that prefixes take. Buckets above HOT times the mean are left out.
FRONT, HOT = 0.3, 4
#: Classes in blocks whose keys are broadcast to pick their texts; more are picked by a shuffled join.
SMALL = 1_000_000
#: Shingles that one task holds at a time (8 bytes each, and as much again for the trie); ties added per part.
PART, TIES = 2_000_000, 32
_U = np.uint64
_NONE = np.empty(0, np.int64)


def shingle_sets(column, size: int = SIZE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per run of rows: first row, hashes of the distinct shingles grouped by row, and where each row's begin."""
    for texts in text_runs(column):
        words = words_of(texts, lower=True)
        counts = np.diff(words.offsets)
        own = windows(words.hashes, size)
        row = words.rows_of_words()
        whole = row[: len(own)] == row[size - 1 :] if len(own) else np.empty(0, bool)
        rows, hashes = row[: len(own)][whole], own[whole]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):  # the whole text is one shingle, of another kind for each length
            single = np.array([windows(words.hashes[words.offsets[r] : words.offsets[r + 1]], counts[r], int(counts[r]) + 77)[0] for r in short], _U)
            rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, single])
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
        yield texts.first, hashes, np.searchsorted(rows, np.arange(texts.rows + 1))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes + _U(5)) & _U(BUCKETS - 1)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many (document, shingle) pairs fall into each bucket; BUCKETS numbers, whatever the input."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, hashes, _ in shingle_sets(batch.column(0)):
                total += np.bincount(_bucket(hashes), minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def in_order(counts: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions that sort by (row, bucket count, hash)."""
    return np.lexsort((hashes, counts[_bucket(hashes)], rows))


def _signature(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    out = []
    for seed in (11, 13):  # sums don't depend on the order
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(hashes + _U(seed)), dtype=_U)])
        out.append(signed(mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(_U))))
    return out


def prefix_size(n):
    return n - (n * OVER + UNDER - 1) // UNDER + 1


def _whole(counts, hashes, rows, at):
    """The whole set in (bucket count, hash) order."""
    return hashes, np.diff(at), np.diff(at)


def _front(counts, hashes, rows, at):
    """The set's exactly counted shingles, then, if they are fewer than the prefix, as many of the others as it lacks."""
    n = np.diff(at)
    often = counts[_bucket(hashes)]
    front = (hashes < _U(int(FRONT * 2**64))) & (often <= HOT * counts.mean() + 1000)
    fronts = np.bincount(rows[front], minlength=len(n))
    before = np.concatenate([[0], np.cumsum(~front)])
    place = before[:-1] - np.repeat(before[at[:-1]], n)  # among the others of the row
    other = ~front & (place < np.repeat(np.where(n > 0, prefix_size(n), 0) - fronts, n))
    chosen = np.concatenate([np.flatnonzero(front), np.flatnonzero(other)])
    chosen = chosen[np.argsort(rows[chosen], kind="stable")]
    return hashes[chosen], np.bincount(rows[chosen], minlength=len(n)), fronts


def set_keys(counts, size: int = SIZE, choose=None):
    """A mapInArrow function (text last) -> the other columns, s1, s2, n; with `choose` shingles, fronts."""

    def keys(batches):
        for batch in batches:
            last = batch.num_columns - 1
            for first, hashes, at in shingle_sets(batch.column(last), size):
                n = np.diff(at)
                own = [*batch.slice(first, len(n)).columns[:last], *(pa.array(c) for c in (*_signature(hashes, at), n))]
                names = [*batch.schema.names[:last], "s1", "s2", "n"]
                if choose:
                    rows = np.repeat(np.arange(len(n)), n)
                    hashes = hashes[in_order(counts.value, hashes, rows)]
                    values, ends, fronts = choose(counts.value, hashes, rows, at)
                    offsets = np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)
                    own += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(values))), pa.array(fronts)]
                    names += ["shingles", "fronts"]
                yield pa.RecordBatch.from_arrays(own, names)

    return keys


class Trie:
    """Compressed tries of ascending int arrays, each with a root of its own; every node knows bounds of what lies below it.

    These are the least and the greatest size of a set and the longest array; a set may be larger than its array.
    """

    __slots__ = ("labels", "children", "low", "high", "longest", "leaves")

    def __init__(self):
        self.labels: list[np.ndarray] = []
        self.children: list[dict[int, int]] = []
        self.low, self.high, self.longest = [], [], []
        self.leaves: list[list[int]] = []

    def root(self) -> int:
        return self._node(_NONE, 1 << 60, 0, 0)

    def _node(self, label, low: int, high: int, longest: int) -> int:
        self.labels.append(label)
        self.children.append({})
        self.low.append(low)
        self.high.append(high)
        self.longest.append(longest)
        self.leaves.append([])
        return len(self.labels) - 1

    def insert(self, root: int, values: np.ndarray, number: int, n: int) -> None:
        node, at, size = root, 0, len(values)
        while at < size:
            child = self.children[node].get(int(values[at]))
            if child is None:
                child = self._node(values[at:], n, n, size)
                self.children[node][int(values[at])] = child
                self.leaves[child].append(number)
                return
            label = self.labels[child]
            m = min(len(label), size - at)
            differ = np.flatnonzero(label[:m] != values[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(label):  # split the edge
                middle = self._node(label[:same], self.low[child], self.high[child], self.longest[child])
                self.children[middle][int(label[same])] = child
                self.labels[child] = label[same:]
                self.children[node][int(values[at])] = middle
                child = middle
            self.low[child], self.high[child] = min(self.low[child], n), max(self.high[child], n)
            self.longest[child] = max(self.longest[child], size)
            node, at = child, at + same
        self.leaves[node].append(number)

    def similar(self, root: int, values: np.ndarray, n: int, mark: np.ndarray, sizes: list[int]) -> int | None:
        """A set below root with Jaccard >= OVER/UNDER to the set of n with these values, which are marked."""
        reach = -(-OVER * n // UNDER)
        stack = [(c, 0, 0) for c in self.children[root].values()]
        while stack:
            node, depth, overlap = stack.pop()
            if self.high[node] < reach:  # every set below is too small
                continue
            label = self.labels[node]
            depth, overlap = depth + len(label), overlap + int(np.count_nonzero(mark[label]))
            rest = min(len(values) - int(np.searchsorted(values, label[-1], "right")), self.longest[node] - depth)
            if (overlap + rest) * (OVER + UNDER) < OVER * (n + max(self.low[node], reach)):
                continue
            for other in self.leaves[node]:
                if overlap * (OVER + UNDER) >= OVER * (n + sizes[other]):
                    return other
            stack += [(c, depth, overlap) for c in self.children[node].values()]
        return None


def trie_links(sets: list[np.ndarray], groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets just as all pairs with Jaccard >= OVER/UNDER would, given that equal groups are connected.

    Sets hold distinct values in the global order's ranks; they are taken from small to large. Values that one set alone has
    count as the rarest and are in no trie. A trie holds sets that are connected, and a walk ends at the first link. A
    component's tries are walked only if it has a value of the walking set's prefix in the prefix of one of its sets.
    """
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[int, int] = {}
    for k, g in enumerate(groups or []):
        parent[find(k)] = find(first.setdefault(g, k))
    sizes = [len(s) for s in sets]
    order = sorted((k for k, n in enumerate(sizes) if n), key=sizes.__getitem__)
    if not order:
        return []
    often = np.bincount(np.concatenate(sets)) > 1
    mark = np.zeros(len(often), bool)
    trie, links = Trie(), []
    roots: dict[int, list[int]] = {}  # of a component's tries, by its root in `parent`
    index: dict[int, list[int]] = {}  # the components that have a value in a prefix, under a root they have or had
    for number in order:
        n, own = sizes[number], sets[number]
        own = own[often[own]]
        # a smaller or equal set shares `least` values at least, and one of the rarest n - least + 1
        least = -(-OVER * (n + max(sizes[order[0]], -(-OVER * n // UNDER))) // (OVER + UNDER))
        near = set()
        for value in own[least - 1 :].tolist():
            held = index.get(value)
            if held:
                now = {find(r) for r in held}
                if len(now) < len(held):
                    index[value] = list(now)
                near |= now
        mine = find(number)
        near.discard(mine)
        if near:
            mark[own] = True
            for other in near:
                for root in roots[other]:
                    link = trie.similar(root, own, n, mark, sizes)
                    if link is not None:
                        links.append((link, number))
                        parent[mine] = other
                        roots[other] += roots.pop(mine, [])
                        mine = other
                        break
            mark[own] = False
        # with a larger or equal set it shares 2 * OVER / (OVER + UNDER) of its own at least
        prefix = own[-(-2 * OVER * n // (OVER + UNDER)) - 1 :].tolist()
        if prefix:
            if mine not in roots:
                roots[mine] = [trie.root()]
            trie.insert(roots[mine][0], own, number, n)
            for value in prefix:
                held = index.setdefault(value, [])
                if not held or held[-1] != mine:
                    held.append(mine)
    return links


_NODE = pa.struct([("s1", pa.int64()), ("s2", pa.int64())])
_EDGES = "a struct<s1:bigint,s2:bigint>, b struct<s1:bigint,s2:bigint>"


def _join_part(counts):
    """applyInArrow: the links of one part, which has columns s1, s2, shingles and, if components are known, label."""

    def join(part: pa.Table) -> pa.Table:
        s1, s2 = part["s1"].to_numpy(), part["s2"].to_numpy()
        _, kept = np.unique(np.stack([s1, s2]), axis=1, return_index=True)  # a tie may be there twice
        lists = part["shingles"].combine_chunks()
        values, offsets = lists.values.to_numpy().view(_U), lists.offsets.to_numpy()
        distinct, where, here = np.unique(values, return_inverse=True, return_counts=True)
        rank = np.empty(len(distinct), np.int64)  # commonest of the part first
        rank[np.lexsort((distinct, counts.value[_bucket(distinct)], here))[::-1]] = np.arange(len(distinct))
        ranks = rank[where]
        sets = [np.sort(ranks[offsets[k] : offsets[k + 1]]) for k in kept]
        groups = None
        if "label" in part.schema.names:
            known = part["label"].to_pylist()
            groups = [(known[k]["s1"], known[k]["s2"]) for k in kept]
        links = trie_links(sets, groups)
        side = lambda i: pa.StructArray.from_arrays([pa.array(s[kept[[x[i] for x in links]]] if links else [], pa.int64()) for s in (s1, s2)], ["s1", "s2"])
        return pa.table({"a": side(0), "b": side(1)})

    return join


def _chained(fronts: DataFrame) -> DataFrame:
    """Edges (a, b) between s1 of classes that share a prefix shingle: each with the next smaller one, if that is in reach.

    A counted shingle that only one class has fills its place in the prefix and is dropped; a class whose prefix is full of
    such ones is out. Very common shingles are not among the counted ones, so the windows hold no hot one.
    """
    prefix = F.col("n") - F.ceil(F.col("n") * OVER / UNDER) + 1
    cut = fronts.select("s1", "n", "fronts", F.posexplode("shingles").alias("place", "t"))
    rows = cut.select("t", "s1", F.col("n").cast("int").alias("n"), F.col("fronts").cast("int").alias("fronts"), (F.col("place") >= F.col("fronts")).alias("other"))
    shared = rows.withColumn("c", F.count("*").over(Window.partitionBy("t"))).where("c > 1")
    own = Window.partitionBy("s1")
    mine = F.sum(F.when(~F.col("other"), 1).otherwise(0)).over(own)
    place = F.row_number().over(own.orderBy("other", "c", "t")) + F.col("fronts") - mine
    return _next_smaller(shared.withColumn("place", place).where(F.col("other") | (F.col("place") <= prefix)).select("t", "s1", "n"))


def _next_smaller(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between s1 of classes with the same t: each with the next smaller one, if that is in reach."""
    by_size = Window.partitionBy("t").orderBy("n", "s1")
    pairs = rows.select("s1", "n", F.lag("s1").over(by_size).alias("b"), F.lag("n").over(by_size).alias("m"))
    return pairs.where(f"b is not null and {UNDER} * m >= {OVER} * n").select(F.col("s1").alias("a"), "b")


def _apart(sets: DataFrame, part: int) -> DataFrame:
    """The sets with blocks of more than `part` shingles split; sets that then have no other to meet are left out.

    In the global order a set A has windows of two neighbouring shingles. Each of the x shingles that B lacks spoils two at
    most, each of the y that only B has spoils one, and 2x + y <= 2 (1 - OVER/UNDER) n where A and B link, whichever is larger.
    So a window among that many and one more of the first is in both, among as many of the first ones of the other.
    Unlike sets seldom share two rare shingles with none of their own between, so what chance joined into blocks falls apart.
    """
    large = sets.groupBy("block").agg(F.sum("n").alias("w")).where(F.col("w") > part).select("block")
    large = staged(large, "large")
    if large.isEmpty():
        return sets
    crowd = sets.join(large, "block", "left_semi")
    # no two sets below four shingles link, unless they are equal
    rows = crowd.where("n > 3").select("s1", "n", F.explode(F.expr(f"transform(sequence(0, int(n * {2 * (UNDER - OVER)} div {UNDER})), i -> xxhash64(shingles[i], shingles[i + 1]))")).alias("t"))
    split = components(_next_smaller(rows)).select(F.col("node").alias("s1"), "root")
    both = sets.join(large.withColumn("large", F.lit(True)), "block", "left").join(split, "s1", "left")
    kept = both.where("large is null or root is not null").withColumn("block", F.coalesce("root", "block"))
    return staged(kept.select(*sets.columns), "splitsets")


def shingle_components(docs: DataFrame, size: int = SIZE, part: int = PART) -> tuple[DataFrame, DataFrame, object]:
    """(rows, labels, counts): rows doc_id, th (hash of the text), s1, s2, n; labels node, root for the classes that have links."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(bucket_counts(texts))  # BUCKETS numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = texts.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = staged(texts.mapInArrow(released(set_keys(counts, size)), f"doc_id {kind}, th bigint, s1 bigint, s2 bigint, n bigint"), "sets", arrow_rows=1_000)
    lists = "s1 bigint, s2 bigint, n bigint, shingles array<bigint>, fronts bigint"
    distinct = lambda df: df.where("n > 0").groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.first("fronts").alias("fronts"))
    fronts = distinct(texts.select("text").mapInArrow(released(set_keys(counts, size, _front)), lists))
    blocks = staged(components(_chained(fronts)), "blocks").select(F.col("node").alias("s1"), F.col("root").alias("block"))
    # the sets of the classes in blocks are cut anew from one text each
    pick = staged(rows.join(blocks, "s1", "left_semi").groupBy("s1", "s2").agg(F.min("th").alias("th")).select("th").distinct(), "picked")
    again = texts.join(F.broadcast(pick) if pick.count() <= SMALL else pick, "th", "left_semi").select("text")
    sets = distinct(again.mapInArrow(released(set_keys(counts, size, _whole)), lists)).drop("fronts")
    sets = _apart(staged(sets.join(blocks, "s1"), "blocksets"), part)
    parts = sets.groupBy("block").agg(F.ceil(F.sum("n") / part).alias("parts"), F.count("*").alias("members"))
    cut = sets.join(parts, "block").withColumn("draw", F.pmod(F.xxhash64("s1", "s2"), F.lit(1 << 40)))
    dealt = cut.withColumn("part", F.explode(F.when((F.col("parts") > 1) & (F.col("draw") % F.col("members") < TIES), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.col("draw") % F.col("parts")))))
    links = dealt.groupBy("block", "part").applyInArrow(_join_part(counts), _EDGES)
    links = staged(links, "links")
    labels = components(links)
    large = parts.where("parts > 1")
    if not large.isEmpty():
        links = links.unionByName(_between_parts(sets.join(large, "block", "left_semi"), labels, counts, part))
        labels = components(links)
    return rows, labels, counts


def _between_parts(sets: DataFrame, labels: DataFrame, counts, part: int) -> DataFrame:
    """Links between the sets of large blocks whose components still differ.

    A large component is cut into parts of its own, small ones are pooled; every two parts of a block meet in one task, but
    for two of the same component.
    """
    node = F.struct("s1", "s2")
    known = sets.withColumn("node", node).join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("node", "root")
    weights = known.groupBy("block", "label").agg(F.sum("n").alias("w"))
    total = known.groupBy("block").agg(F.ceil(F.sum("n") / part).alias("pools"))
    df = known.join(weights, ["block", "label"]).join(total, "block")
    alone = F.col("w") > part
    draw = F.pmod(F.xxhash64("s1", "s2"), F.ceil(F.col("w") / part))
    name = F.when(alone, F.struct(F.col("label.s1").alias("x"), F.col("label.s2").alias("y"), draw.alias("z")))
    name = name.otherwise(F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.pmod(F.xxhash64("label"), F.col("pools")).alias("z")))
    df = df.withColumn("piece", name).drop("w", "pools")
    pieces = df.groupBy("block", "piece").agg(F.when(F.min("label") == F.max("label"), F.min("label")).alias("only"))
    pairs = pieces.alias("p").join(pieces.alias("q"), (F.col("p.block") == F.col("q.block")) & (F.col("p.piece") <= F.col("q.piece")))
    pairs = pairs.where("p.only is null or q.only is null or p.only <> q.only")
    pairs = pairs.select(F.col("p.block").alias("block"), F.col("p.piece").alias("p"), F.col("q.piece").alias("q"))
    ends = pairs.select("block", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("piece"))
    return staged(df.join(ends, ["block", "piece"]).groupBy("block", "p", "q").applyInArrow(_join_part(counts), _EDGES), "links")


def component_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows, labels, _ = shingle_components(docs)
    by = labels.select(F.col("node.s1").alias("s1"), F.col("node.s2").alias("s2"), "root")
    # equal sets without further links are components too
    per_class = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"))
    per_class = per_class.join(by, ["s1", "s2"], "left").withColumn("root", F.coalesce("root", F.struct("s1", "s2")))
    least = per_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = per_class.join(least, "root").select("s1", "s2", "component_id")
    full = rows.where("n > 0").join(named, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_per_component(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest doc_id (of equal ones the one whose text has the smallest hash), as it is.

    Documents without shingles all stay.
    """
    rows, labels, _ = shingle_components(docs)
    by = labels.select(F.col("node.s1").alias("s1"), F.col("node.s2").alias("s2"), "root")
    per_class = rows.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("least"))
    per_class = per_class.join(by, ["s1", "s2"], "left").withColumn("root", F.coalesce("root", F.struct("s1", "s2")))
    winner = per_class.groupBy("root").agg(F.min(F.struct("least", "s1", "s2")).alias("w"))
    winner = winner.select(F.col("w.s1").alias("s1"), F.col("w.s2").alias("s2"), F.col("w.least.doc_id").alias("doc_id"))
    # of rows that tie on doc_id and set the one whose text has the smallest hash, found in the table of sets: no text is cut again
    winner = winner.withColumnRenamed("doc_id", "wd")
    tied = rows.where("n > 0").join(winner, (rows["s1"] == winner["s1"]) & (rows["s2"] == winner["s2"]) & rows["doc_id"].eqNullSafe(winner["wd"]))
    picks = tied.groupBy(rows["s1"], rows["s2"], "wd").agg(F.min("th").alias("wth")).select("wd", "wth")
    (row,) = fresh(docs, "row")
    text = F.col("text").cast("string")
    whole = docs.select(F.struct(*docs.columns).alias(row), F.col("doc_id").alias("d"), F.xxhash64(text).alias("th"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    kept = whole.where("worded").join(picks, (whole["th"] == picks["wth"]) & whole["d"].eqNullSafe(picks["wd"]))
    kept = kept.groupBy("th", "d").agg(F.first(row).alias(row))  # repeated rows are one
    out = kept.select(row).unionByName(whole.where("not worded").select(row))
    return out.select(*[F.col(row)[c].alias(c) for c in docs.columns])
