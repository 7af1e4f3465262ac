"""Source divergence, the conversation trie and near-duplicate vectors beside plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import divergence, embedding_dedup, prefix_trie, queries

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, min_docs=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = []
    for lang in {r[0] for r in rows}:
        counts, docs = defaultdict(Counter), Counter()
        for _, source, text in (r for r in rows if r[0] == lang):
            words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text)]
            counts[source].update(words)
            docs.update(set(words))
        kept = sorted(t for t in docs if docs[t] >= min_docs)
        whole = Counter()
        for c in counts.values():
            whole.update(c)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                found += [(lang, s, part, k.decode(), -v, i + 1) for i, (v, k) in enumerate(items)]
    return sorted(found)


def test_divergence_like_a_plain_count(spark, monkeypatch):
    draw = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(300)] + ["Ab", "aB", "日本", "\x80x"]
    rows = []
    for i in range(400):
        # A third of all documents is of one source, and some words stand everywhere.
        source = "hot" if i % 3 == 0 else f"s{draw.randrange(6)}"
        text = " ".join(draw.choice(words[: draw.choice([3, 40, 304])]) for _ in range(draw.randrange(60)))
        rows.append(("en" if i % 5 else None, source if i % 11 else None, text if i % 17 else None))
    rows += rows[:20] + [("xx", "a", "one"), ("xx", "b", None), ("yy", "a", "x1x2x\x00x x\x7fx"), ("yy", "b", "X")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term int, chunk int")
    monkeypatch.setattr(divergence, "RARE", 30)
    found = divergence.source_divergence(docs, "text", "lang", "source", top=20)
    assert sorted(map(tuple, found.collect())) == plain_divergence(rows, top=20)


def test_levels_in_blocks(monkeypatch):
    rows = [(f"g{g}", n, w, 1 << (7 * g + n) | 5, 1000 * n + g, 3 + g) for g in range(4) for n in range(1, 4) for w in range(2)]
    whole = sorted(divergence._compare(rows))
    monkeypatch.setattr(divergence, "BLOCK", 2)
    summed = Counter()
    for a, b, v in divergence._compare(rows):
        summed[a, b] += v
    assert sorted((a, b, v) for (a, b), v in summed.items()) == whole


def test_divergence_of_odd_texts(spark, odd, none):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    found = divergence.source_divergence(docs, "text", "lang", "source")
    rows = [(None, r.source, r.text) for r in odd.collect()]
    assert sorted(map(tuple, found.collect())) == plain_divergence(rows)
    assert divergence.source_divergence(none.withColumn("lang", F.lit("a")), "text", "lang", "source").count() == 0


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, d, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        paths[c] = tuple(own.get(base, [])[:h]) + tuple(own[c][h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(paths[c]) == len(p))
        up = members[p[:-1]][0] if p else None
        out.append((m[0], len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shards", [1, 2, 13])
def test_trie_like_plain_prefixes(spark, shards, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 5)
    draw = random.Random(shards)
    texts = ["hi", "go on", "a b c", "", " \t", "é 日本 x", "y" * 5000, "hi"]
    rows = []
    for c in [*range(-45, 150), *range(1000, 1000 + 20 * 12)]:
        n = draw.choice([0, 1, 2, 2, 3, 6]) or 1
        if c >= 1000:  # a third are copies of one conversation
            rows += [(c, t, "user", "same thing") for t in range(5)]
        else:
            rows += [(c, draw.choice([t, t, None]), draw.choice(["user", "bot", None]), draw.choice(texts)) for t in range(n)]
    rows += [(7, t, "user", f"turn {t}") for t in range(120)] + rows[:9] + [(None, 1, "user", "nobody"), (33, None, None, None)]
    turns = spark.createDataFrame([(*r, b"", 3) for r in rows], "conv_id long, turn long, role string, text string, key binary, depth int")
    found = prefix_trie.prefix_trie(turns, shards=shards)
    assert sorted(map(tuple, found.collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).count() == 0
    only = spark.createDataFrame([(None, 1, "user", "x")], none.schema)
    assert prefix_trie.prefix_trie(only).count() == 0


def test_splitters_keep_to_their_bound(spark):
    paths = spark.createDataFrame([(bytes([i // 16]) * 64 + bytes([i]) * 160,) for i in range(256)], "path binary")
    cuts = prefix_trie.splitters(paths, 16)
    assert cuts == sorted(set(cuts)) and len(cuts) == 15
    assert sum(map(len, prefix_trie.splitters(paths, 16, most_bytes=200))) <= 200


def brute_links(rows, least=0.9):
    """Links and components of ``id, vector`` by all cosines."""
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / max(abs(x) for x in v)
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    dims = max((len(u) for u in units if u is not None), default=1)
    x = np.array([np.zeros(dims) if u is None else np.pad(u, (0, dims - len(u))) for u in units])
    near = (x @ x.T >= least) & ~np.eye(len(x), dtype=bool)
    ids = [r[0] for r in rows]
    least_id = [float("inf") if i is None else i for i in ids]
    changed = True
    while changed:
        low = [min([least_id[i], *(least_id[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
        changed, least_id = low != least_id, low
    least_id = [None if x == float("inf") else x for x in least_id]
    return sorted(zip(ids, near.sum(axis=1).tolist(), least_id, [a is not None and a == b for a, b in zip(ids, least_id)]), key=str)


def near(draw, v, cosine):
    """A vector at this cosine from the unit vector ``v``."""
    o = draw.standard_normal(len(v))
    o -= (o @ v) * v
    return cosine * v + np.sqrt(1 - cosine**2) * o / np.linalg.norm(o)


def random_unit(draw, dims=64):
    v = draw.standard_normal(dims)
    return v / np.linalg.norm(v)


VECTORS = "vec_id long, embedding array<float>, label int, class int, unit int"


@pytest.mark.parametrize("options", [{}, {"leaf": 20, "cell": 40}, {"leaf": 20, "cell": 7, "trees": 6}])
def test_vectors_like_all_cosines(spark, options):
    draw = np.random.default_rng(3)
    base = [random_unit(draw) for _ in range(300)]
    hot, warm = random_unit(draw), random_unit(draw)
    # A third are near copies of one vector, others lie just outside of that group, and equal ones repeat.
    x = [*base, *(near(draw, hot, 0.995) for _ in range(250)), *(near(draw, warm, 0.99) for _ in range(30))]
    x += [near(draw, hot, draw.uniform(0.88, 0.97)) for _ in range(15)] + [base[0] * 3] * 40 + [near(draw, b, 0.97) for b in base[:60]]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    draw.shuffle(rows := [tuple(r) for r in rows])
    rows = [(int(i), v) for i, v in rows]
    table = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], VECTORS)
    found = sorted(map(tuple, embedding_dedup.near_duplicates(table, "vec_id", "embedding", **options).collect()), key=str)
    want = brute_links(rows)
    links = sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(found, want)) and sum(r[1] for r in found) >= 0.97 * links
    if not options:
        assert found == want


def test_two_narrow_groups_that_touch(spark):
    draw = np.random.default_rng(8)
    one = random_unit(draw)
    other, third = near(draw, one, 0.91), near(draw, one, 0.93)
    x = [near(draw, c, q) for c, q in ((one, 0.9999), (other, 0.985), (third, 0.9999)) for _ in range(150)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], VECTORS)
    for cell in (embedding_dedup.CELL, 60):
        found = embedding_dedup.near_duplicates(table, "vec_id", "embedding", cell=cell)
        assert sorted(map(tuple, found.collect()), key=str) == brute_links(rows)


def test_recall_near_the_threshold(spark):
    draw = np.random.default_rng(4)
    x = [random_unit(draw) for _ in range(6000)]
    x += [near(draw, x[i], draw.uniform(0.901, 0.95)) for i in range(2000)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], VECTORS)
    found = embedding_dedup.near_duplicates(table, "vec_id", "embedding", leaf=60, cell=200)
    assert found.agg(F.sum("n_links")).head()[0] >= 0.9 * 4000


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0]),
        (9, [1e-40, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (10, [3e38, 3e38]), (11, [1e-3, 1e-3]), (None, [-1.0, 0.0]), (12, [-0.0, 1.0]),
        (13, [0.0, 1.0]),
    ]
    table = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], VECTORS)
    found = embedding_dedup.near_duplicates(table, "vec_id", "embedding").collect()
    assert sorted(map(tuple, found), key=str) == brute_links(rows)
    assert embedding_dedup.near_duplicates(table.where("false"), "vec_id", "embedding").count() == 0


def test_vectors_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_projection_forest(spark, SF).collect()), key=str) == brute_links(rows)
