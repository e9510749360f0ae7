"""Plain, slow versions of the operators, row by row, to compare results with."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import xxhash

GAP = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, h string, shard int"


def awkward(seed=7, n=60):
    """Documents with nulls, empty and long texts, repeated rows and ids, copies, near copies and shared passages."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(1, 7))) for _ in range(900)]
    text = lambda k: " ".join(rnd.choice(vocabulary) + ("\n" if rnd.random() < 0.1 else "") for _ in range(k))
    passage, base = text(80), text(150)
    texts = [None, "", "   \n\t ", "a", "Short Text one two", "...", "𝒳😀 emoji 😀 text " * 6, "x" * 450, "ab " * 300, text(4000), base, base, base.upper(), passage]
    for _ in range(n - len(texts)):
        kind = rnd.randrange(4)
        if kind == 0:
            words = base.split(" ")
            for _ in range(rnd.randint(1, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind == 1:
            texts.append(text(rnd.randint(5, 60)) + "\n" + passage + "\n" + text(rnd.randint(0, 60)))
        else:
            texts.append(text(rnd.randint(1, 200)))
    langs, sources = ["en", "de", None, "fr"], ["s1", "s2", "s3", None, ""]
    rows = [(i * 3, t, langs[i % 4], sources[i % 5] if i % 3 else "s1", len(t) if t else 0, "x", "y", 5) for i, t in enumerate(texts)]
    rows.append(rows[20])  # a repeated row
    rows.append((None, base + " end", "en", "s2", 1, "x", "y", 5))
    rnd.shuffle(rows)
    return rows


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def bytes_removed(rows):
    """{id: (n_bytes, n_removed, n_spans, sha)}; equal rows are one document."""
    out, seen = {}, set()
    for r in by_id({(r[0], r[1]): r for r in rows}.values()):
        data = (r[1] or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[r[0]] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def words_removed(rows):
    out, first = {}, {}
    key = lambda i: (i is None, i or 0)
    words = {r[0]: [w.encode() for w in GAP.findall(r[1] or "")] for r in rows}
    for i in sorted(words, key=key):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if key(first[tuple(w[k : k + 50])]) < key(i):
                gone[k : k + 50] = [True] * 50
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


_LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    words = (text or "").encode().translate(_LOW).split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def components(rows):
    """[(id, n_shingles, component_id)], sorted."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def normal_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = normal_words(text)
        for k in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[k : k + 10])].add(str(item))
    out = []
    for r in rows:
        words, hit, found = normal_words(r[1]), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if (w := tuple(words[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[w]
        out.append((r[0], len(words), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def targets(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(GAP.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, free, rest = {}, set(order), sum(sizes.values())
    while True:
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * sizes[s] + 1e-9}
        if not over:
            return sizes, out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
            rest -= out[s]
        free -= over


def lines_kept(rows):
    """{id: (n_lines, n_removed, sha)}"""
    first, order, similar = {}, [], set()
    for r in by_id(rows):
        for i, line in enumerate(r[1].split("\n") if r[1] is not None else []):
            s = frozenset(GAP.findall(line))
            if s and s not in first:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in order):
                    similar.add(s)
                first[s] = (r[0], i)
                order.append(s)
    out = {}
    for r in rows:
        lines = r[1].split("\n") if r[1] is not None else []
        kept = [x for i, x in enumerate(lines) if not (s := frozenset(GAP.findall(x))) or s not in similar and first[s] == (r[0], i)]
        out[r[0]] = (len(lines), len(lines) - len(kept), sha("\n".join(kept).encode()))
    return out


def _h64(*parts):
    seed = 42
    for v in parts:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def fingerprint(text, k=16, s=12, keep=64):
    if len(text) < k:
        return [_h64(text) >> 32] if text else []
    h = [_h64(text[i : i + s]) for i in range(len(text) - s + 1)]
    return sorted({_h64(h[i], h[i + k - s]) >> 32 for i in range(len(text) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])})[:keep]


def likeness(a, b):
    if not a and not b:
        return 1.0
    both = sorted(set(a) | set(b))[:64]
    return len(set(both) & set(a) & set(b)) / len(both)


def simhash(text):
    words = GAP.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def linked_fingerprints(fps, radius=3):
    """{fingerprint: its component} by comparing all pairs."""
    fps, root = sorted(set(fps)), {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def simhash_components(rows):
    """[(id, fingerprint in hex, component id)]"""
    fps = [simhash(r[1]) for r in rows]
    root = linked_fingerprints(fps)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    return [(r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps)]


_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in _TERM.findall(text or "")]


def ranks(rows, items, top=20):
    """[(item, rank, doc, score)] by scoring every document."""
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    df = Counter(t for _, c in docs for t in c)
    big_n, big_l = sum(1 for _, c in docs if c), sum(c.total() for _, c in docs)
    out = []
    for item in {i for i, _ in items}:
        asked = Counter(t for text in {x for i, x in items if i == item} for t in terms(text))
        scored = []
        for doc, c in docs:
            m = 75 + 25 * c.total() * big_n // max(1, big_l)
            score = sum(q * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return out


def aligned(texts, a, bytes_a, b, bytes_b):
    """For each text: n_a, n_b, groups, links (a, b), by whole texts and byte offsets; None without tokens."""
    out = []
    for text in texts:
        data = b" " + (text or "").encode()
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or b"".join(bytes_a[i] for i in x) != data or b"".join(bytes_b[i] for i in y) != data:
            out.append(None)
            continue
        ends = []
        for ids, table in ((x, bytes_a), (y, bytes_b)):
            at, own = 0, []
            for i in ids:
                at += len(table[i])
                own.append(at)
            ends.append(own)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links, low = [], [], 0
        for high in both:
            side = lambda k, ids: [(i, e - len((bytes_a, bytes_b)[k][i]), e) for i, e in zip(ids, ends[k]) if low < e <= high]  # noqa: E731, B023
            p, q = side(0, x), side(1, y)
            groups.append(",".join(str(i) for i, _, _ in p) + "|" + ",".join(str(i) for i, _, _ in q))
            links += [(i, j) for i, s, e in p for j, s2, e2 in q if max(s, s2) < min(e, e2)]
            low = high
        out.append((len(x), len(y), groups, links, both))
    return out
