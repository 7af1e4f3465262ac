"""The trie of conversation prefixes, by a skeleton of range splitters.

A conversation is the path of its turns' digests, and paths in order are the trie in depth-first
order. Equal paths are added up first. Splitters cut the order into shards, and the trie of the splitters
is the skeleton, which every task gets: a node that is no prefix of a splitter has all of its
paths in one shard, and a sorted pass with a stack finishes it there. Skeleton nodes get partial
sums from each shard; these are reduced by key, and the small skeleton is closed from its leaves up.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import WORD, parked, partitions

#: Bytes of a turn's digest, the head of a SHA-256.
STEP = 16
#: Splitters for each shuffle partition, paths sampled for each splitter, and bytes of all
#: splitters: what is broadcast. Beyond that every second splitter goes, which changes no row.
SHARDS, SAMPLED, SKELETON_BYTES = 2, 16, 4_000_000
#: Ids of a chunk that is hashed at once.
CHUNK = 4096

_NODE = (
    "key binary, parent binary, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long"
)


#: The root's key.
ROOT = hashlib.sha256().digest()[:STEP]


def node_key(above: bytes, step: bytes) -> bytes:
    """The key of a node, a digest of its parent's key and its own turn."""
    return hashlib.sha256(above + step).digest()[:STEP]


def steps(path: bytes) -> list[bytes]:
    return [path[i : i + STEP] for i in range(0, len(path), STEP)]


def turn_digest(role: Column, text: Column) -> Column:
    """A digest that tells turns apart; the length of the role parts it from the text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, STEP)


def rebuilt_paths(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, fan: int = 20, heads: int = 4) -> DataFrame:
    """``conv_id, key, path, words``: each conversation after it takes its first turns from another one.

    Conversation ``c`` gets the first ``h`` turns of conversation ``c - c % fan`` in place of its own first ``h``, with
    ``h = crc32(c) % heads``. Turns are ordered by ``turn``, null first, then by digest. ``path`` joins the
    digests, ``words`` has each turn's number of words and ``key`` is that of the node where it ends.
    """
    names = {"conv_id": conv_id, "turn": turn, "role": role, "text": text}
    read = turns.select(*(F.col(f"`{c}`").alias(n) for n, c in names.items())).where("conv_id is not null")
    read = read.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    digests = read.select(
        "conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("d"), F.regexp_count("text", F.lit(WORD)).alias("w")
    )
    own = parked(
        digests.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "w"))).alias("t"))
        .select("conv_id", F.col("t.d").alias("d"), F.col("t.w").alias("w")),
        "conversations",
    )
    c = F.col("conv_id")
    own = own.withColumns({"h": F.pmod(F.crc32(c.cast("string")), F.lit(heads)).cast("int"), "base": c - c % fan})
    heads_of = own.select(
        F.col("conv_id").alias("base"), F.slice("d", 1, heads - 1).alias("head_d"), F.slice("w", 1, heads - 1).alias("head_w")
    )

    def joined(own_part: str, head: str) -> Column:
        return F.expr(f"concat(slice(coalesce({head}, array()), 1, h), slice({own_part}, h + 1, size({own_part})))")

    found = own.join(heads_of, "base", "left").select("conv_id", joined("d", "head_d").alias("d"), joined("w", "head_w").alias("words"))

    def down(above: Column, step: Column) -> Column:
        return F.substring(F.unhex(F.sha2(F.concat(above, step), 256)), 1, STEP)

    return found.select(
        "conv_id", F.aggregate("d", F.lit(ROOT), down).alias("key"),
        F.unhex(F.array_join(F.transform("d", lambda x: F.hex(x)), "")).alias("path"), "words",
    )


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their head."""
    n, most = 0, min(len(a), len(b)) // STEP
    while n < most and a[n * STEP : (n + 1) * STEP] == b[n * STEP : (n + 1) * STEP]:
        n += 1
    return n


def splitters(paths: DataFrame, shards: int, sampled: int = SAMPLED, most_bytes: int = SKELETON_BYTES) -> list[bytes]:
    """At most ``shards - 1`` ordered paths that cut the given ones into shards of similar size.

    A splitter is the shortest path that parts two neighbours of a sample, so it is seldom long. The sample
    has ``sampled`` paths for each shard. Splitters are dropped until all together have at most ``most_bytes``.
    """
    picked = paths.select(F.xxhash64("path").alias("h"), "path").orderBy("h", "path").limit(shards * sampled)
    # Only a bounded head of each sampled path reaches the driver; any path is a splitter.
    head = most_bytes // (shards * sampled) // STEP * STEP
    seen = sorted({bytes(r[0]) for r in picked.select(F.substring("path", 1, max(head, STEP))).toLocalIterator()})
    cuts = sorted({seen[i * len(seen) // shards] for i in range(1, shards)}) if len(seen) > 1 else []
    out = []
    for cut in cuts:
        at = seen.index(cut)
        if at:
            out.append(cut[: (_shared(seen[at - 1], cut) + 1) * STEP])
    while sum(map(len, out)) > most_bytes:
        out = out[1::2]
    return out


def skeleton(cuts: list[bytes]) -> dict[bytes, tuple[bytes | None, int]]:
    """All prefixes of the splitters, the root included: key to parent's key and depth."""
    bones: dict[bytes, tuple[bytes | None, int]] = {ROOT: (None, 0)}
    for cut in cuts:
        key = ROOT
        for depth, step in enumerate(steps(cut), 1):
            above, key = key, node_key(key, step)
            bones[key] = above, depth
    return bones


@dataclass(slots=True)
class _Node:
    key: bytes
    words: int
    bone: bool
    least: int
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    waiting: list = field(default_factory=list)


class _Pass:
    """A stack over sorted paths: the nodes of the path that is open, from the root down."""

    def __init__(self, bones: dict):
        self.bones, self.stack, self.rows, self.last = bones, [], [], b""

    def close(self, depth: int) -> None:
        """Takes the nodes from ``depth`` down off the stack."""
        while len(self.stack) > depth:
            x = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            if not x.bone:
                x.leaves += not x.children
                x.saved += (x.n - 1) * x.words
            # A finished node's children waited for its least member.
            self.rows += [(*r[:4], x.least, *r[5:]) for r in x.waiting]
            row = (x.key, above and above.key, len(self.stack), x.least, None, x.n, x.children, x.leaves, x.saved, x.words, x.bone)
            if x.bone or above.bone:
                self.rows.append(row)
            else:
                above.waiting.append(row)
            if above:
                above.n += x.n
                above.least = min(above.least, x.least)
                if not x.bone:
                    above.children += 1
                    above.leaves += x.leaves
                    above.saved += x.saved

    def add(self, path: bytes, n: int, least: int, words: list[int]) -> None:
        self.close(_shared(self.last, path) + 1)
        if not self.stack:
            self.stack.append(_Node(ROOT, 0, True, least))
        for d in range(len(self.stack) - 1, len(path) // STEP):
            key = node_key(self.stack[-1].key, path[d * STEP : (d + 1) * STEP])
            self.stack.append(_Node(key, words[d], key in self.bones, least))
        top = self.stack[-1]
        top.n += n
        top.least = min(top.least, least)
        self.last = path

    def taken(self) -> pa.RecordBatch:
        columns = [*zip(*self.rows)] or [()] * 11
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.bool_()]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*_names(_NODE), "words", "skeleton"])


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _shard_nodes(cuts: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, walk = None, _Pass(skeleton(cuts.value))
        for batch in batches:
            for at, path, n, least, words in zip(*(c.to_pylist() for c in batch.columns)):
                if at != shard:
                    walk.close(0)
                    shard, walk.last = at, b""
                walk.add(path, n, least, words)
            if len(walk.rows) >= CHUNK:
                yield walk.taken()
        walk.close(0)
        yield walk.taken()

    return run


def _closed(spark: SparkSession, cuts: list[bytes], parts: DataFrame) -> DataFrame:
    """The skeleton's nodes, whole: sums of the shards' parts, then one pass from the leaves up.

    Their number is bounded by ``SKELETON_BYTES`` over ``STEP``. A splitter's last turns may be the head of no path.
    """
    sums = parts.where("skeleton").groupBy("key").agg(
        F.min("conv_id").alias("least"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"),
    )
    bones, found = skeleton(cuts), {bytes(r.key): r.asDict() for r in sums.toLocalIterator()}
    rows = []
    for key in sorted(found, key=lambda k: -bones[k][1]):
        x, (up, depth) = found[key], bones[key]
        x["leaves"] += not x["children"]
        x["saved"] += (x["n"] - 1) * x["words"]
        if up:
            above = found[up]
            above["children"] += 1
            above["leaves"] += x["leaves"]
            above["saved"] += x["saved"]
        rows.append((key, up, depth, x["least"], up and found[up]["least"], x["n"], x["children"], x["leaves"], x["saved"]))
    return spark.createDataFrame(rows, _NODE)


def end_digests(members: DataFrame) -> DataFrame:
    """``key, ends``: SHA-256 of the decimal ids of each ``key, conv_id``, in order, comma-joined.

    Ids are sorted over ranges, so many of one key stand in many tasks, and joined to chunks. A
    digest takes its bytes in order: one task reads a key's chunks as a stream and holds none of them.
    """

    def table(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
        columns = [*zip(*rows)] or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, out = None, [], []

        def taken() -> pa.RecordBatch:
            rows = [(k, x[0], ",".join(map(str, x))) for k, x in out]
            out.clear()
            return table(rows, key=pa.binary(), first=pa.int64(), ids=pa.string())

        for batch in batches:
            for key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now or len(ids) >= CHUNK:
                    if ids:
                        out.append((now, ids))
                    now, ids = key, []
                ids.append(conv)
            yield taken()
        if ids:
            out.append((now, ids))
        yield taken()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def taken() -> pa.RecordBatch:
            rows = list(out)
            out.clear()
            return table(rows, key=pa.binary(), ends=pa.string())

        for batch in batches:
            for key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if state:
                        out.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield taken()
        if state:
            out.append((now, state.hexdigest()))
        yield taken()

    ranged = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = ranged.mapInArrow(chunks, "key binary, first long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends string")


def prefix_trie(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    shards: int | None = None,
) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (see ``rebuilt_paths``).

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the node above (root: null), ``n_convs`` the
    members, ``n_children`` and ``n_leaves`` the children and the childless nodes below (itself included),
    ``saved_tokens`` the words that need not be stored twice below, ``ends_sha256`` the SHA-256 of the ids that end here.

    Null role or text is empty; a null ``turn`` comes first; turns that tie in ``turn`` go by their digest, and
    repeated rows are turns of their own. Rows without a conversation id belong to none. A conversation may be
    turnless and ends at the root then. Texts of any length count by a 128-bit digest; a conversation's
    digests fit in one row. Other columns are not read. An empty table has no nodes.
    """
    spark = turns.sparkSession
    paths = parked(rebuilt_paths(turns, conv_id, turn, role, text), "paths")
    distinct = paths.groupBy("key").agg(
        F.first("path").alias("path"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("words").alias("words")
    )
    distinct = parked(distinct, "distinct-paths")
    cuts = splitters(distinct, shards or SHARDS * partitions(spark))
    shared = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def shard_of(path: pd.Series) -> pd.Series:
        return path.map(lambda p: bisect.bisect_right(shared.value, bytes(p))).astype("int32")

    sharded = distinct.select(shard_of("path").alias("shard"), "path", "n", "least", "words")
    ordered = sharded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "path")
    parts = parked(ordered.mapInArrow(_shard_nodes(shared), f"{_NODE}, words long, skeleton boolean"), "trie-parts")

    whole = _closed(spark, cuts, parts)
    least = F.broadcast(whole.select(F.col("key").alias("bone"), F.col("conv_id").alias("its_least")))
    local = parts.where("not skeleton").join(least, F.col("parent") == F.col("bone"), "left")
    local = local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "its_least")).select(*_names(_NODE))
    return local.unionByName(whole).join(end_digests(paths), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
