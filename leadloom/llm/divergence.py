"""How far the vocabulary of each source stands from the others of its language.

Terms are numbered in chunks, and each chunk stores, for every (group, count), the bitset of the
terms that the group holds so often. A term's share in a group depends on its count only, so a
pair of groups needs no terms: the AND of two bitsets and its popcount give a joint cell, the
number of terms with count ``a`` here and ``b`` there, and each cell is multiplied by its
divergence ``f(a, b)``. Cells with a zero count follow by complement from the number of terms of
each count: with ``n`` terms in a cell and ``0`` for "not held",

    sum f = sum_a T(a) f(a,0) + sum_b T(b) f(0,b) + (V - |A| - |B|) f(0,0)
            + sum_joint n(a,b) (f(a,b) - f(a,0) - f(0,b) + f(0,0))
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import parked, partitions

#: A term is kept if at least so many documents of its language hold it.
MIN_DOCS = 3
#: Shares are whole numbers of this part.
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Terms with fewer occurrences in their language share wide chunks: they have few counts.
RARE = 256
WIDTH_OF_RARE, WIDTH = 2048, 64
#: Entries a task counts before it hands them on; levels that are compared at once.
HELD, BLOCK = 400_000, 1024

#: Bytes of UTF-8 that belong to terms stay (A-Z in lower case), all others part them.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, as far as a task has read."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.repeat(pa.scalar(lang), len(terms)), "source": pa.repeat(pa.scalar(source), len(terms)),
                    "term": pa.array(terms, pa.binary()).cast(pa.string()),
                    "n": pa.array(n.values(), pa.int64()),
                    "docs": pa.array([docs[t] for t in n], pa.int64()),
                }
            )
        counts.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            words, before = text.encode().translate(_LETTERS).split(), len(n)
            n.update(words)
            docs.update(set(words))
            held += len(n) - before + 1
            if held >= HELD:
                yield from handed()
                held = 0
    yield from handed()


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang, term, source, n, docs``: occurrences and documents of each term in each group.

    Each task adds up before the shuffle, so a group may hold any share of the documents. Rows are dealt out by
    term alone, which serves the sums over all groups as well.
    """
    read = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang, source, text)))
    partial = read.toDF("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``k, bit``, a chunk and a place in it for each term, counting the terms of a task in their order."""
    task, last, seen = TaskContext.get().partitionId(), None, -1
    for batch in batches:
        if not len(batch):
            continue
        head = [batch.column(c)[0].as_py() for c in ("lang", "term")]
        new = np.ones(len(batch), bool)
        new[0] = head != last
        new[1:] = False
        for c in ("lang", "term"):
            v = batch.column(c)
            new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
        place = seen + np.cumsum(new)
        last, seen = [batch.column(c)[-1].as_py() for c in ("lang", "term")], int(place[-1])
        width = np.where(batch.column("rare").to_numpy(zero_copy_only=False), WIDTH_OF_RARE, WIDTH)
        k = (task << 33) + place // width
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k), pa.array((place % width).astype(np.int32))], [*batch.schema.names, "k", "bit"])


def numbered_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, source, n, total, rare, k, bit``: the kept terms of each group, numbered without a global order.

    ``total`` counts a term in its language. A number is a place in a partition of terms in which terms of similar
    frequency stand together; the chunk ``lang, rare, k`` and the ``bit`` say it.
    """
    term = Window.partitionBy("lang", "term")
    kept = (
        counts.withColumns({"total": F.sum("n").over(term), "all_docs": F.sum("docs").over(term)})
        .where(F.col("all_docs") >= min_docs)
        .select("lang", "term", "source", "n", "total", (F.col("total") < RARE).alias("rare"))
    )
    schema = "lang string, term string, source string, n long, total long, rare boolean, k long, bit int"
    return kept.sortWithinPartitions("rare", "lang", "total", "term").mapInArrow(_numbered, schema)


def _share(n: str, total: str, terms: str) -> str:
    """SQL of ``1 + floor(SCALE * (n + 1) / (total + terms))`` as a long, exact for any count."""
    of = f"nullif({total} + {terms}, 0)"
    wide = f"cast((cast({SCALE} as decimal(38,0)) * (cast({n} as decimal(20,0)) + 1)) div {of} as bigint)"
    return f"1 + if({n} < {2**62 // SCALE}, {SCALE}L * ({n} + 1) div {of}, {wide})"


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / q)`` of shares; at most about SCALE^2, which fits 64 bits."""
    d = p - q
    return d * d // q


def _compare(rows: list[tuple]) -> Iterator[tuple[str, str, int]]:
    """``source, item, value`` of one chunk, from its ``source, n, word, bits, p, zero``."""
    names = {s: i for i, s in enumerate(dict.fromkeys(r[0] for r in rows))}
    if len(names) < 2:
        return
    levels = {k: i for i, k in enumerate(dict.fromkeys(r[:2] for r in rows))}
    words = {w: i for i, w in enumerate(sorted({r[2] for r in rows}))}
    at = np.array([levels[r[:2]] for r in rows])
    bits = np.zeros((len(levels), len(words)), np.int64)
    bits[at, [words[r[2]] for r in rows]] = [r[3] for r in rows]
    bits = bits.view(np.uint64)
    group, p, zero = (np.zeros(len(levels), np.int64) for _ in range(3))
    group[at], p[at], zero[at] = [names[r[0]] for r in rows], [r[4] for r in rows], [r[5] for r in rows]
    label = list(names)
    for lo in range(0, len(levels), BLOCK):
        for at_b in range(0, len(levels), BLOCK):
            a, b = bits[lo : lo + BLOCK], bits[at_b : at_b + BLOCK]
            cells = np.zeros((len(a), len(b)), np.int64)
            for w in range(len(words)):
                cells += np.bitwise_count(a[:, w, None] & b[None, :, w])
            cells[group[lo : lo + BLOCK, None] == group[None, at_b : at_b + BLOCK]] = 0
            i, j = np.nonzero(cells)
            n, i, j = cells[i, j], i + lo, j + at_b
            if not len(n):
                continue
            f = divergence(p[i], p[j]) - divergence(p[i], zero[j]) - divergence(zero[i], p[j]) + divergence(zero[i], zero[j])
            pair = group[i] * len(names) + group[j]
            order = np.argsort(pair, kind="stable")
            seen, first = np.unique(pair[order], return_index=True)
            for k, v in zip(seen.tolist(), np.add.reduceat((f * n)[order], first).tolist()):
                yield label[k // len(label)], label[k % len(label)], v


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the joint cells of each chunk add to its pairs, summed over the chunks of the task.

    Rows come by chunk. A chunk has at most one level for each of its terms and groups; levels are
    compared in blocks.
    """
    sums: dict[tuple[str, str, str], int] = {}

    def add(key: tuple, rows: list[tuple]) -> None:
        for source, item, value in _compare(rows):
            k = key[0], source, item
            sums[k] = sums.get(k, 0) + value

    def flush() -> Iterator[pa.RecordBatch]:
        columns = [*zip(*sums)] or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.string()) for c in columns), pa.array(sums.values(), pa.int64())], ["lang", "source", "item", "value"]
        )
        sums.clear()

    now, rows = None, []
    for batch in batches:
        for lang, rare, k, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, rare, k) != now:
                if rows:
                    add(now, rows)
                if len(sums) >= HELD:
                    yield from flush()
                now, rows = (lang, rare, k), []
            rows.append(tuple(row))
    if rows:
        add(now, rows)
    yield from flush()


def _paired(groups: DataFrame, items: DataFrame, salts: int) -> DataFrame:
    """Each group beside every other one of its language; groups are dealt out by salt, the small side is repeated."""
    left = groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(salts)))
    right = items.withColumnsRenamed({c: f"item_{c}" for c in items.columns if c != "lang"})
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, ["lang", "salt"]).where(F.col("source") != F.col("item_source"))


def source_divergence(
    docs: DataFrame, text: str, lang: str, source: str, min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets a source apart in its language.

    Part ``pair`` has every other source of the language with the sum of ``f`` over all kept terms,
    part ``term`` the ``top`` terms that the source uses more than its language does. ``f`` is
    ``floor((p - q)^2 / q)`` of shares with one added to each count, in whole numbers throughout.

    Null text, language and source count as empty ones, and an empty one is a group like any other. Groups
    without terms have pairs, of value 0 where no term is kept. Ties in value go by the item's UTF-8
    bytes. Repeated rows count each time. Other columns are not read. An empty table gives an empty table.
    The rows of pairs grow with the square of a language's sources, as the result asks for each pair.
    """
    salts = partitions(docs.sparkSession)
    counts = term_counts(docs, text, lang, source)
    held = parked(numbered_terms(counts, min_docs), "kept-counts")
    every = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))))

    # One row for each group: what it holds, and how many terms it holds how often.
    levels = held.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"))
    levels = levels.groupBy("lang", "source").agg(
        F.sum(F.col("n") * F.col("terms")).alias("total"), F.sum("terms").alias("held"),
        F.collect_list(F.struct("n", "terms")).alias("levels"),
    )
    # Every chunk tells its terms by their bits.
    chunks = held.groupBy("lang", "rare", "k", "bit").agg(F.sum("n").alias("n"))
    langs = chunks.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("of_lang"))
    groups = (
        every.distinct()
        .join(levels, ["lang", "source"], "left").join(langs, "lang", "left")
        .na.fill(0, ["total", "held", "v", "of_lang"])
        .withColumn("zero", F.expr(_share("0", "total", "v")))
        .withColumn("levels", F.expr(f"transform(levels, x -> struct({_share('x.n', 'total', 'v')} as p, x.terms as terms))"))
    )
    groups = parked(groups, "groups")
    sizes = groups.select("lang", "source", "total", "v", "of_lang", "zero")

    bitmaps = (
        held.groupBy("lang", "rare", "k", "source", "n", F.expr("bit div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("bits"))
        .join(sizes, ["lang", "source"])
        .select("lang", "rare", "k", "source", "n", "word", "bits", F.expr(_share("n", "total", "v")).alias("p"), "zero")
    )
    schema = "lang string, source string, item string, value long"
    joint = bitmaps.repartition("lang", "rare", "k").sortWithinPartitions("lang", "rare", "k").mapInArrow(_pairs, schema)

    # By complement: terms of one group that the other lacks, and terms that both lack.
    own = _paired(groups, sizes.select("lang", "source", "zero"), salts).select(
        "lang", "source", F.col("item_source").alias("item"),
        F.expr(f"coalesce(aggregate(levels, 0L, (s, x) -> s + x.terms * {_f('x.p', 'item_zero')}), 0L)").alias("value"),
    )
    theirs = _paired(groups, groups.select("lang", "source", "zero", "held"), salts).select(
        "lang", F.col("item_source").alias("source"), F.col("source").alias("item"),
        F.expr(
            f"coalesce(aggregate(levels, 0L, (s, x) -> s + x.terms * {_f('item_zero', 'x.p')}), 0L)"
            f" + coalesce((v - held - item_held) * {_f('item_zero', 'zero')}, 0L)"
        ).alias("value"),
    )
    pairs = (
        joint.unionByName(own).unionByName(theirs)
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    terms = (
        held.withColumnRenamed("total", "all_n").join(sizes, ["lang", "source"])
        .withColumns({"p": F.expr(_share("n", "total", "v")), "q": F.expr(_share("all_n", "of_lang", "v"))})
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    )
    return pairs.unionByName(terms)
