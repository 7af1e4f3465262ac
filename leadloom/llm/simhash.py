"""Near-duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints that differ in at most ``d`` of 64 bits agree on ``b - d`` of any ``b`` blocks of
bits. For every choice of that many blocks, the fingerprints that share the pattern of the
chosen bits form an upper node of the index: all others are pruned at once. Within an
upper node fingerprints stand in Gray order, in which neighbours differ in few bits. Leaves
of consecutive fingerprints carry the mask and pattern of the bits they share; two leaves
whose common masked bits already differ in more than ``d`` places are pruned whole, and
only what is left is compared bit by bit.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import boxed, parked, partitions
from leadloom.llm.graph import components

WORDS = 4
MAX_BITS = 4
LEAF = 32
#: Fingerprints of an upper node that meet in one task; larger nodes are dealt out in pairs of parts.
NODE = 4096
#: Bits of the numbers of two parts of a node, which stand with the choice of blocks and the side in one number.
PART = 23
CHOICE = 2 * PART + 1
#: Fingerprints of an upper node on average, at most. Fewer would take more blocks, and each multiplies the rows that are shuffled.
CROWD = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of the text's word shingles, as a signed integer."""
    import xxhash

    # bytes.split() takes exactly the white space that separates words here.
    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        part = zip(starts[lo : lo + (1 << 15)], ends[lo : lo + (1 << 15)])
        h = np.array([digest(joined[a:b], 42) for a, b in part], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    """SimHash as a column; a null or empty text has fingerprint 0."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return run(text)


def block_masks(blocks: int, agree: int) -> list[int]:
    """A mask for every choice of ``agree`` of ``blocks`` blocks of the 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(block, agree)]


def choose_blocks(fingerprints: int, max_bits: int = MAX_BITS) -> int:
    """The least number of blocks whose patterns hold ``CROWD`` fingerprints or fewer on average.

    Any number gives the same links; this one balances copies against comparisons.
    """
    for blocks in range(max_bits + 2, 3 * max_bits + 1):
        if fingerprints <= CROWD * 2 ** (64 * (blocks - max_bits) / blocks):
            return blocks
    return 3 * max_bits + 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(column: Column) -> Column:
    """The position of a bit pattern in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, shift))
    return column


def _leaf_links(x: np.ndarray, left: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels by which the fingerprints ``x``, in Gray order, hang together.

    ``left`` marks the part whose members are compared with those of the other part, or with
    all if there is one part only.
    """
    n = len(x)
    pad = -n % LEAF
    filled = np.concatenate([x, np.repeat(x[-1:], pad)]).reshape(-1, LEAF)
    shared_one, shared_any = np.bitwise_and.reduce(filled, 1), np.bitwise_or.reduce(filled, 1)
    mask = ~(shared_one ^ shared_any)  # bits that all of a leaf share
    label, two = np.arange(n), bool((~left).any() and left.any())
    for leaf in range(len(filled)):
        rows = np.arange(leaf * LEAF, min(n, (leaf + 1) * LEAF))
        near = np.bitwise_count((shared_one ^ shared_one[leaf]) & mask & mask[leaf]) <= max_bits
        near[:leaf] = False
        cols = (np.flatnonzero(near)[:, None] * LEAF + np.arange(LEAF)).ravel()
        cols = cols[cols < n]
        hit = np.bitwise_count(x[rows][:, None] ^ x[cols][None, :]) <= max_bits
        if two:
            hit &= (left[rows][:, None] != left[cols][None, :]) | (rows[:, None] == cols[None, :])
        # Those of a leaf that meet the same fingerprint hang together.
        met = hit.astype(np.float32)
        todo, meets = set(range(len(rows))), (met @ met.T) > 0
        while todo:
            group = {todo.pop()}
            edge = set(group)
            while edge:
                edge = {j for i in edge for j in np.flatnonzero(meets[i]).tolist()} & todo
                todo -= edge
                group |= edge
            at = cols[hit[list(group)].any(0)]
            old = np.unique(label[np.concatenate([at, rows[list(group)]])])
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
    return label


def _links(masks: list[int], max_bits: int):
    """Links of sorted runs of upper nodes; rows of a node follow each other, each with its place in the Gray order."""
    masks_u = np.array(masks, np.uint64)

    def solve(choice, node, x, left):
        kind, choice = choice // len(masks), choice % len(masks)
        cut = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]).any(1)]))
        sizes = np.diff(np.append(cut, len(x)))
        a, b, of = [], [], []
        # Nodes of one leaf: compare each with the next few.
        run = np.repeat(np.arange(len(cut)), sizes)
        small = np.repeat(sizes, sizes) <= LEAF
        for step in range(1, min(LEAF, int(sizes.max(initial=0)))):
            i = np.flatnonzero(small[:-step] & (run[:-step] == run[step:]))
            if not len(i):
                break
            differ = x[i] ^ x[i + step]
            ok = np.bitwise_count(differ) <= max_bits
            i, differ = i[ok], differ[ok]
            # A pair is told by the first choice of blocks it agrees on.
            agrees = (differ[:, None] & masks_u[None, :]) == 0
            first = agrees.argmax(1) == choice[i]
            a.append(x[i][first])
            b.append(x[i + step][first])
            of.append(kind[i][first])
        for k in np.flatnonzero(sizes > LEAF):
            part = slice(cut[k], cut[k] + sizes[k])
            label = _leaf_links(x[part], left[part], max_bits)
            other = np.flatnonzero(label != np.arange(len(label)))
            a.append(x[part][other])
            b.append(x[part][label[other]])
            of.append(kind[part][other])
        return np.concatenate(of or [kind[:0]]), np.concatenate(a or [x[:0]]), np.concatenate(b or [x[:0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                pattern, at, rank = (batch.column(i).to_numpy() for i in range(3))
                x = rank.view(np.uint64)
                new = [at >> CHOICE, np.stack([pattern, at >> 1], 1), x ^ (x >> np.uint64(1)), (at & 1).astype(bool)]
                kept = new if kept is None else [np.concatenate([p, q]) for p, q in zip(kept, new)]
                if not len(kept[0]):
                    continue
                same = (kept[1] == kept[1][-1]).all(1)
                ready = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            elif kept is None:
                return
            else:
                ready = len(kept[0])
            if ready:
                of, a, b = solve(*(k[:ready] for k in kept))
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])
                kept = [k[ready:] for k in kept]

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, node: int = NODE) -> DataFrame:
    """Links ``a, b`` that connect exactly what differences of ``max_bits`` or fewer connect.

    ``fps`` has distinct fingerprints in ``fp``. Small nodes give every link, larger ones a
    forest of them. A node of more than ``node`` fingerprints is cut into parts by hash, and
    each pair of parts is a task's work, so no task holds a whole large node. Fingerprints of different
    kinds may stand in ``fps``, told apart by a column ``kind`` that the links have as well.
    """
    kinds = ["kind"] if "kind" in fps.columns else []
    n = fps.count()
    blocks = blocks or choose_blocks(n, max_bits)
    masks = block_masks(blocks, blocks - max_bits)
    kind = F.col("kind").cast("long") * len(masks) if kinds else F.lit(0).cast("long")
    every = F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("mask")
    mask = F.array(*(F.lit(_signed(m)) for m in masks))
    key = ["choice", "pattern"]
    rows = fps.select("fp", kind.alias("kind"), every).select(
        "fp", (F.col("kind") + F.col("mask")).alias("choice"), F.col("fp").bitwiseAND(mask[F.col("mask")]).alias("pattern")
    )
    # Few sums of many nodes tell which nodes may be large; only those are counted.
    sums = max(64, n * len(masks) * 4 // node)
    hashed = rows.withColumn("sum", F.pmod(F.xxhash64(*key), F.lit(sums)))
    crowded = parked(hashed.groupBy("sum").count().where(F.col("count") > node).select("sum"), "crowded-nodes")
    large = hashed.join(crowded, "sum", "left_semi").groupBy(*key).count().where(F.col("count") > node)
    large = parked(large.select(*key, F.ceil(F.col("count") / node).cast("long").alias("parts")), "large-nodes")
    rows = rows.join(large, key, "left")
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))

    def place(p: Column, q: Column, left: Column) -> Column:
        low = F.shiftleft(p, PART + 1).bitwiseOR(F.shiftleft(q, 1)).bitwiseOR(left.cast("long"))
        return F.shiftleft("choice", CHOICE).bitwiseOR(low)

    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: place(F.least(part, j), F.greatest(part, j), part <= j)
    )
    alone = F.array(place(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(True)))
    met = rows.select("fp", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(pairs)).alias("at"))
    # Two numbers a row are shuffled; the pattern and the place in the Gray order follow from them.
    pattern = F.col("fp").bitwiseAND(mask[F.pmod(F.shiftright("at", CHOICE), F.lit(len(masks))).cast("int")])
    met = met.repartition(partitions(fps.sparkSession), F.shiftright("at", 1), pattern)
    met = met.select(pattern.alias("pattern"), "at", gray_rank(F.col("fp")).alias("rank"))
    met = met.sortWithinPartitions("pattern", F.shiftright("at", 1), "rank")
    return met.mapInArrow(_links(masks, max_bits), "kind long, a long, b long").select(*kinds, "a", "b")


def _fingerprints(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return parked(
        rows.select("key", F.xxhash64("text").alias("content"), fingerprint_column(F.col("text"), words).alias("fp")),
        "fingerprints",
    )


def _classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root`` for the distinct fingerprints that have a link."""
    links = fingerprint_links(parked(prints.select("fp").distinct(), "distinct-fingerprints"), max_bits)
    return parked(components(links).withColumnRenamed("node", "fp"), "classes")


def near_duplicates(
    docs: DataFrame, key: str, text: str, words: int = WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """``key, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 hexadecimal digits. Rows belong together if links of at most
    ``max_bits`` differing bits lead from one to the other; ``component_id`` is the least key
    of those. Copies share one fingerprint and are linked once, whatever their number.

    Null and empty texts, and those of white space, have fingerprint zero and are linked
    like any other. Rows with a null key get the least key of their component, or null where
    it has none. Repeated rows are all returned. Columns other than ``key`` and ``text`` are
    not looked at. An empty table gives an empty table.
    """
    prints = _fingerprints(docs, key, text, words)
    roots = _classes(prints, max_bits).withColumnRenamed("fp", "linked")
    least = prints.groupBy("fp").agg(F.min("key").alias("least"))
    placed = parked(
        least.join(roots, F.col("fp") == F.col("linked"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")),
        "placed",
    )
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = parked(placed.join(heads, "root").select(F.col("fp").alias("of"), "component_id"), "component-ids")
    out = prints.join(ids, F.col("fp") == F.col("of"))
    return out.select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str, text: str, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` of which one of each component stays, all columns as they were.

    The row with the least key stays (null keys come last); among rows of the same key, the
    one with the least hash of its text, and one of rows that agree in both.
    """
    prints = _fingerprints(docs, key, text, words)
    roots = _classes(prints, max_bits).withColumnRenamed("fp", "linked")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "content")
    heads = parked(prints.groupBy("fp").agg(F.min(order).alias("head")), "heads")
    kept = (
        heads.join(roots, F.col("fp") == F.col("linked"), "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("head").alias("head"))
        .select(F.coalesce(F.col("head.key").cast("string"), F.lit("")).alias("of"), F.col("head.none").alias("none"), F.col("head.content").alias("content"))
    )
    kept = parked(kept, "kept")
    rows = boxed(
        docs, of=F.coalesce(F.col(key).cast("string"), F.lit("")), none=F.col(key).isNull(),
        content=F.xxhash64(F.col(text).cast("string")),
    )
    on = ["of", "none", "content"]
    return rows.join(kept, on, "left_semi").dropDuplicates(on).select("row.*")


# ---- near-duplicates by shared shingles -------------------------------------------

#: Words of a shingle and the share of shingles that similar texts have in common; fingerprints
#: of a text, each from its own hash, and the bits in which one of them may differ.
SHINGLE, SIMILAR, PRINTS, PRINT_BITS = 5, 0.8, 6, 5
#: One of how many texts tells which shingles are common, and how many of those are put last. They decide the
#: order of the shingles only: any order gives the same links.
COMMON_OF, COMMON = 16, 50_000
#: Texts of a posting list that are compared in one block; candidates of one text that are checked in one task.
LIST, TOGETHER = 2048, 512


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word shingles, sorted. A text without words has none."""
    import xxhash

    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[min(words, len(tokens)) - 1 :].tolist())), np.uint64, n))


def set_fingerprints(hashes: np.ndarray, prints: int = PRINTS) -> np.ndarray:
    """SimHashes of a set of hashes, one for each of ``prints`` ways to mix them, as signed integers."""
    out = np.zeros(prints, np.uint64)
    for k in range(prints):
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(hashes), 1 << 15):
            x = hashes[lo : lo + (1 << 15)]
            if k:
                x = (x ^ np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
            ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The share of all hashes that both sets hold; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of the hashes that fall on each bit, a bit or two for each hash, as bytes.

    Two sets differ in at least as many members as their sketches in bits. Halves of a sketch, set against each
    other, give the sketch of half the size.
    """
    bits = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def may_be_similar(a: bytes, n: int, b: bytes, m: int, least: float) -> bool:
    """Whether sets of ``n`` and ``m`` hashes with these sketches may have the share ``least`` in common."""
    if min(n, m) < least * max(n, m) - 1e-6:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (n + m) * (1 - least) / (1 + least) + 1e-6


def _possible(least: float):
    """The pairs ``x, y`` whose sketches do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("sketch_x", "size_x", "sketch_y", "size_y"))
            ok = [may_be_similar(*x, least) for x in zip(*columns)]
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return run


def _similar(words: int, least: float):
    """Pairs of similar texts; rows are sorted by ``y, part, x``, and the text of ``y`` itself, without ``x``, comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for x, one in zip(*(batch.column(c).to_pylist() for c in ("x", "text"))):
                if x is None:
                    other = shingles(one, words)
                ok.append(x is not None and jaccard(shingles(one, words), other) >= least)
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return run


def _candidates(classes: DataFrame, prints: int, max_bits: int, least: float) -> DataFrame:
    """``x, y`` with ``x > y``: classes of which some fingerprint is near, and all of them not too far.

    Classes of one fingerprint are linked through the least of them.
    """
    of_kind = classes.select("cls", F.posexplode("prints").alias("kind", "fp"))
    held = parked(of_kind.groupBy("kind", "fp").agg(F.min("cls").alias("head")), "heads-of-prints", "zstd")
    links = fingerprint_links(held.select("kind", "fp"), max_bits, choose_blocks(classes.count(), max_bits)).where("a <> b")
    links = parked(links, "links-of-prints")
    one, other = (held.select("kind", F.col("fp").alias(a), F.col("head").alias(x)) for a, x in ("ax", "by"))
    far = links.join(one, ["kind", "a"]).join(other, ["kind", "b"]).select("x", "y")
    near = of_kind.join(held, ["kind", "fp"]).select(F.col("cls").alias("x"), F.col("head").alias("y"))
    found = far.unionByName(near)
    pairs = found.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    # A bit differs with the probability of the angle between two sets; four deviations above that of ``least``.
    p = np.arccos(2 * least / (1 + least)) / np.pi
    most = int(64 * prints * p + 4 * np.sqrt(64 * prints * p * (1 - p)))
    of = [classes.select(F.col("cls").alias(c), F.col("prints").alias(f"of_{c}")) for c in "xy"]
    apart = F.aggregate(F.zip_with("of_x", "of_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
    return pairs.join(of[0], "x").join(of[1], "y").where(apart <= most).select("x", "y")


def _common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """The commonest shingles of a part of the texts, the rarest of them first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                h = np.concatenate([shingles(t, words) for t in batch.column(0).slice(lo, 256).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    part = texts.where(F.pmod("id", F.lit(COMMON_OF)) == 0).dropDuplicates(["id"]).select("text")
    held = part.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    top = parked(held.orderBy(F.desc("n"), "h").limit(COMMON), "common-shingles").orderBy(F.desc("n"), "h").toArrow()
    return top.column("h").to_numpy()[::-1].view(np.uint64).copy()


def _prefixes(words: int, least: float, common: np.ndarray):
    """``h, id, at`` of the prefix of each text: its size and the place of the shingle are in ``at``.

    Of two sets with the share ``least`` in common one of the first ``n - ceil(least n) + 1`` members of either,
    in any one order, is the same (Chaudhuri, Ganti, Kaushik 2006; Bayardo, Ma, Srikant 2007).
    """
    by_hash = np.argsort(common)
    known = common[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, seen, out = batch.slice(lo, 256), set(), []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if i in seen:
                        continue
                    seen.add(i)
                    h = shingles(text, words)
                    n = max(1, len(h))
                    if len(known) and len(h):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        rank = np.where(known[at] == h, by_hash[at], -1)
                        h = h[np.argsort(rank, kind="stable")]
                    h = h[: n - int(np.ceil(least * n - 1e-9)) + 1] if len(h) else np.zeros(1, np.uint64)
                    out.append((h.view(np.int64), np.full(len(h), i), (n << 32) + np.arange(len(h))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["h", "id", "at"])

    return run


def _shared_lists(lists: DataFrame) -> DataFrame:
    """The rows of lists that hold two texts at least, each text once."""

    def solve(rows):
        h, ids, _ = rows
        rows = rows[:, np.concatenate([[True], (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])])]
        same = rows[0][1:] == rows[0][:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return pa.RecordBatch.from_arrays([pa.array(c[shared]) for c in rows], names=["h", "id", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((3, 0), np.int64)
        for batch in batches:
            kept = np.concatenate([kept, np.stack([batch.column(k).to_numpy() for k in range(3)])], 1)
            ready = int(np.argmax(kept[0] == kept[0][-1])) if kept.shape[1] else 0
            if ready:
                yield solve(kept[:, :ready])
                kept = kept[:, ready:]
        if kept.shape[1]:
            yield solve(kept)

    dealt = lists.repartition(partitions(lists.sparkSession), "h").sortWithinPartitions("h", "id")
    return parked(dealt.mapInArrow(run, "h long, id long, at long"), "shared-lists", "zstd")


def _list_pairs(least: float, thin: bool):
    """Pairs of texts of different groups that share a shingle of their prefixes and may be similar.

    Rows are sorted by list, size and text. ``thin`` gives each text only the next one of another group
    in its list; that joins most groups, so that few pairs are left when all are asked for.
    """
    need = least / (1 + least)

    def pairs(x, root, n, at, left):
        order = [np.zeros(0, np.int64)] * 2
        i, j = [order[0]], [order[1]]
        room = n - at
        # Sizes ascend: what may be similar to a text lies in one run after it.
        until = np.searchsorted(n, np.floor(n / least + 1e-9), "right")
        for k in range(len(x) - 1):
            hi = int(until[k])
            other = root[k + 1 : hi] != root[k]
            if thin:
                to = k + 1 + np.flatnonzero(other)[:1]
            else:
                if left is not None:
                    other &= left[k + 1 : hi] != left[k]
                to = k + 1 + np.flatnonzero(other)
                to = to[np.minimum(room[k], room[to]) >= np.ceil(need * (n[k] + n[to]) - 1e-6)]
            i.append(np.full(len(to), k))
            j.append(to)
        i, j = np.concatenate(i), np.concatenate(j)
        return x[i], x[j]

    def solve(x):
        key, ids, n, at, root, left = x
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        a, b = [], []
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
            if hi - lo > 1 and (root[lo:hi] != root[lo]).any():
                sides = left[lo:hi]
                two = sides if sides.any() and not sides.all() else None
                one, other = pairs(ids[lo:hi], root[lo:hi], n[lo:hi], at[lo:hi], two)
                a.append(one)
                b.append(other)
        a, b = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (a, b))
        found = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            new = [np.stack(c[:3], 1), c[3], c[4] >> 32, c[4] & 0xFFFFFFFF, c[5], c[6].astype(bool)]
            kept = new if kept is None else [np.concatenate(p) for p in zip(kept, new)]
            if not len(kept[1]):
                continue
            ready = int(np.argmax((kept[0] == kept[0][-1]).all(1)))
            if ready:
                yield solve([k[:ready] for k in kept])
                kept = [k[ready:] for k in kept]
        if kept is not None and len(kept[1]):
            yield solve(kept)

    return run


def _more_pairs(lists: DataFrame, roots: DataFrame, least: float, thin: bool) -> DataFrame:
    """``x, y``: ids of texts that share a list and lie in different groups, lists of one group left out.

    A list of more than ``LIST`` texts is dealt out in parts, and each pair of parts is a task's work.
    """
    rows = lists.join(roots.select(F.col("id").alias("of"), "root"), F.col("id") == F.col("of"), "left")
    rows = parked(rows.select("h", "id", "at", F.coalesce("root", "id").alias("root")), "grouped-lists", "zstd")
    mixed = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other")
    many = F.lit(1) if thin else F.ceil(F.col("n") / LIST).cast("int")
    rows = rows.join(parked(mixed.select("h", many.alias("parts")), "mixed-lists"), "h")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("p"), F.greatest("part", j).alias("q"))
    )
    rows = rows.select("h", "id", "at", "root", "part", F.explode(blocks).alias("b")).select(
        "h", F.col("b.p").cast("long").alias("p"), F.col("b.q").cast("long").alias("q"), "id", "at", "root", (F.col("part") == F.col("b.p")).alias("left")
    )
    key = ["h", "p", "q"]
    dealt = rows.repartition(partitions(lists.sparkSession), *key).sortWithinPartitions(*key, "at", "id")
    return dealt.mapInArrow(_list_pairs(least, thin), "x long, y long").distinct()


def keep_one_similar(
    docs: DataFrame, key: str, text: str, words: int = SHINGLE, least: float = SIMILAR, prints: int = PRINTS, max_bits: int = PRINT_BITS
) -> DataFrame:
    """The rows of ``docs`` of which one of each group of similar texts stays, all columns as they were.

    Texts are similar if ``least`` of the distinct ``words``-word shingles of both are in both; groups are what similar
    texts connect. Candidates come from the Gray-order index over several fingerprints of each text, and from a join over
    prefixes of the shingle sets that finds all links between the groups of the index. Every link is
    checked on the whole texts. Equal texts are one, and large nodes of the index give a forest of links.

    The row with the least key stays (null keys come last); among rows of the same key, the one with the least hash of
    its text, and one of rows that agree in both. Null and empty texts and those of white space are similar to each
    other. An empty table gives an empty table. Other columns may have any names.
    """
    body = F.col(f"`{text}`").cast("string")

    @F.pandas_udf("prints array<bigint>, sketch binary, size int")
    def printed(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, words) for t in texts]
        columns = [set_fingerprints(s, prints) for s in sets], [sketch(s) for s in sets], [len(s) for s in sets]
        return pd.DataFrame(dict(zip(("prints", "sketch", "size"), columns)))

    cls = F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), 1, 16)
    texts = docs.select(F.col(f"`{key}`").alias("key"), body.alias("text")).withColumn("cls", cls)
    order = F.struct(F.col("key").isNull().alias("none"), "key", F.xxhash64("text").alias("content"))
    rows = texts.select("cls", order.alias("head"), printed(F.col("text")).alias("of")).select("cls", "head", "of.*")
    rows = parked(rows, "set-fingerprints")
    classes = parked(
        rows.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("prints", "sketch", "size")), F.min("head").alias("head")), "text-classes"
    )
    ids = parked(classes.select("cls", F.xxhash64("cls").alias("id")), "text-ids")

    def checked(near: DataFrame) -> DataFrame:
        # Most candidates are ruled out by their sketches, so that few texts are sent.
        for c in "xy":
            near = near.join(classes.select(F.col("cls").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("size").alias(f"size_{c}")), c)
        near = parked(near.mapInArrow(_possible(least), "x binary, y binary"), "candidates")
        # Each text goes to its pairs in one shuffle, that of y ahead of those it is compared with.
        parts = near.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("long").alias("parts"))
        dealt = near.join(parts, "y").select("x", "y", F.pmod(F.xxhash64("x"), F.col("parts")).alias("part"))
        wanted = dealt.select(F.col("x").alias("cls"), "x", "y", "part").unionByName(
            dealt.select(F.col("y").alias("cls"), F.lit(None).cast("binary").alias("x"), "y", "part").distinct()
        )
        bodies = texts.select("cls", "text").join(wanted.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
        both = wanted.join(bodies, "cls").select("x", "y", "part", "text").repartition(partitions(docs.sparkSession), "y", "part")
        alike = both.sortWithinPartitions("y", "part", F.col("x").asc_nulls_first()).mapInArrow(_similar(words, least), "x binary, y binary")
        return parked(alike.select(F.col("x").alias("a"), F.col("y").alias("b")), "similar")

    alike = checked(_candidates(classes, prints, max_bits, least))
    roots = parked(components(alike), "similar-groups")
    # The index misses some links: a join over prefixes of all texts finds every one between its groups.
    named = texts.select(F.xxhash64("cls").alias("id"), "text")
    lists = named.mapInArrow(_prefixes(words, least, _common_shingles(named, words)), "h long, id long, at long")
    lists = _shared_lists(lists)
    for thin in (True, False):
        of = roots.join(ids, F.col("node") == F.col("cls")).select("id", F.xxhash64("root").alias("root"))
        more = _more_pairs(lists, of, least, thin)
        more = more.join(ids.select(F.col("id").alias("x"), F.col("cls").alias("one")), "x").join(ids.select(F.col("id").alias("y"), F.col("cls").alias("other")), "y")
        alike = parked(alike.unionByName(checked(more.select(F.greatest("one", "other").alias("x"), F.least("one", "other").alias("y")))), "all-similar")
        roots = parked(components(alike), "similar-groups")
    kept = (
        classes.join(roots, F.col("cls") == F.col("node"), "left")
        .groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("head").alias("head"))
        .select(F.coalesce(F.col("head.key").cast("string"), F.lit("")).alias("of"), F.col("head.none").alias("none"), F.col("head.content").alias("content"))
    )
    kept = parked(kept, "kept")
    boxes = boxed(docs, of=F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), none=F.col(f"`{key}`").isNull(), content=F.xxhash64(body))
    on = ["of", "none", "content"]
    return boxes.join(kept, on, "left_semi").dropDuplicates(on).select("row.*")
