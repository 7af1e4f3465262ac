"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree halves the vectors again and again by random directions. Vectors near a cut go to both sides (spill), so
that a near pair is seldom parted in one tree, and hardly ever in all. Pairs are compared in double precision
within the leaves; a pair that meets in several leaves counts in the least of them only. The
links of a leaf leave it as counts and as a spanning forest, never as pairs, and are united over all leaves.

Equal vectors are one class. Groups of near copies that hold a fair share of all vectors
would fill any leaf; they are found in a sample as balls so narrow that all their members link with each
other. Such pairs are counted, not compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from leadloom.llm.common import boxed, parked
from leadloom.llm.graph import components

COSINE = 0.9
TREES = 4
#: Vectors up to this distance from a cut go to both sides; a cut must lower the pairs to this share.
SPILL, GAIN = 0.025, 0.9
#: Vectors of a leaf as planned; a leaf beyond ``CELL`` is cut again, or else compared in parts of this size.
LEAF, CELL = 512, 2048
#: Vectors on which the first cuts are fitted, those among them that show balls, and the least members of a ball there.
SAMPLE, BALL_SAMPLE, BALL_MEMBERS = 8192, 4096, 16
#: Directions tried for a cut, levels of later rounds, and rounds.
TRIED, LEVELS, ROUNDS = 4, 4, 40


def _direction(node: int, place: int, dims: int) -> np.ndarray:
    """The random unit vectors of a cut, the same wherever they are drawn: a row for each one tried."""
    x = np.random.default_rng([node & (2**63 - 1), place]).standard_normal((TRIED, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _child(node: int, place: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{node}:{place}".encode(), digest_size=8).digest(), "big", signed=True)


def fit_cuts(x: np.ndarray, node: int, levels: int, weight: float, leaf: int = LEAF, spill: float = SPILL) -> np.ndarray:
    """Cuts of a node in heap order, as rows of ``direction, place``; direction -1 ends in a leaf.

    ``x`` is a sample in which a row stands for ``weight`` vectors. A cut goes where it leaves the fewest
    pairs, spill counted, so it avoids dense places. What no cut parts stays a leaf.
    """
    cuts = np.full((2**levels - 1, 2), -1.0)

    def split(rows: np.ndarray, place: int) -> None:
        if place > len(cuts) or len(rows) * weight <= leaf or len(rows) < 8:
            return
        at = x[rows] @ _direction(node, place, x.shape[1]).T
        best = (GAIN, -1, 0.0)
        for k in range(at.shape[1]):
            p = np.sort(at[:, k])
            for c in np.unique(p[(np.linspace(0.05, 0.95, 19) * (len(p) - 1)).astype(int)]):
                low, high = np.searchsorted(p, c + spill, "right"), len(p) - np.searchsorted(p, c - spill, "right")
                best = min(best, ((low**2 + high**2) / len(p) ** 2, k, float(c)))
        if best[1] < 0:
            return
        cuts[place - 1] = best[1:]
        p = at[:, best[1]]
        split(rows[p <= best[2] + spill], 2 * place)
        split(rows[p > best[2] - spill], 2 * place + 1)

    split(np.arange(len(x)), 1)
    return cuts


def walk(x: np.ndarray, node: int, cuts: np.ndarray, spill: float = SPILL) -> Iterator[tuple[np.ndarray, int]]:
    """``rows, leaf`` of all leaves that the vectors reach. A node without a cut is its own leaf."""
    todo = [(np.arange(len(x)), 1)]
    while todo:
        rows, place = todo.pop()
        if not len(rows):
            continue
        direction = int(cuts[place - 1, 0]) if place <= len(cuts) else -1
        if direction < 0:
            yield rows, node if place == 1 else _child(node, place)
            continue
        p = x[rows] @ _direction(node, place, x.shape[1])[direction]
        cut = cuts[place - 1, 1]
        todo += [(rows[p <= cut + spill], 2 * place), (rows[p > cut - spill], 2 * place + 1)]


def find_balls(x: np.ndarray, least: float = COSINE, members: int = BALL_MEMBERS) -> np.ndarray:
    """Centres of groups so narrow that any two members link: within half the angle of ``least`` of the centre."""
    half, free, found = np.sqrt((1 + least) / 2), np.ones(len(x), bool), []
    near = x @ x.T >= half
    while len(x):
        degree = (near & free[None, :]).sum(axis=1) * free
        if degree.max() < members:
            break
        mine = near[degree.argmax()] & free
        centre = x[mine].mean(axis=0)
        centre /= np.linalg.norm(centre)
        inside = (x @ centre >= half) & free
        if inside.sum() < mine.sum():
            centre, inside = x[degree.argmax()], mine
        found.append(centre)
        free &= ~(inside | mine)
    return np.array(found).reshape(len(found), x.shape[1])


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of ``width`` numbers each as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a digest of each vector, or null where it cannot have a cosine."""
    for batch in batches:
        keys = []
        for v in batch.column("vector").to_pylist():
            x = np.array(v if v is not None and None not in v else [], np.float64) + 0.0
            ok = 0 < np.abs(x).max(initial=0) < np.inf
            keys.append(hashlib.blake2b(x, digest_size=16).digest() if ok else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["id", "vector", "key"])


def _least_common(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether no node before ``leaf`` is in both rows; rows are padded with the largest integer."""
    apart = np.ones(len(a), bool)
    for k in range(a.shape[1]):
        mine = a[:, k]
        if (mine < leaf).any():
            apart &= ~((mine < leaf) & (mine[:, None] == b).any(axis=1))
    return apart


def _compare(cell: pd.DataFrame, dims: int, least: float) -> pd.DataFrame:
    """``class, n, root``: links of the classes of a cell, and the least class that they join here."""
    leaf, a, b = cell[["leaf", "a", "b"]].iloc[0]
    x = _units(np.vstack(cell["vector"].to_numpy()).astype(np.float64))
    ids, copies, ball = (cell[c].to_numpy() for c in ("class", "copies", "ball"))
    left = np.flatnonzero(cell["side"].to_numpy() == 0)
    right = left if a == b else np.flatnonzero(cell["side"].to_numpy() == 1)
    nodes = None
    if not cell["whole"].iloc[0]:
        width = max(map(len, cell["nodes"]))
        nodes = np.full((len(cell), width), np.iinfo(np.int64).max)
        for row, own in zip(nodes, cell["nodes"]):
            row[: len(own)] = own
    n, root = np.zeros(len(cell), np.int64), np.arange(len(cell))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    links = []
    for lo in range(0, len(left), 1024):
        rows = left[lo : lo + 1024]
        i, j = np.nonzero(x[rows] @ x[right].T >= least)
        i, j = rows[i], right[j]
        ok = ids[i] < ids[j] if a == b else ids[i] != ids[j]
        ok &= (ball[i] < 0) | (ball[i] != ball[j])
        i, j = i[ok], j[ok]
        for at in range(0, len(i) if nodes is not None else 0, 1 << 18):
            part = slice(at, at + (1 << 18))
            new = _least_common(nodes[i[part]], nodes[j[part]], leaf)
            links.append((i[part][new], j[part][new]))
        if nodes is None:
            links.append((i, j))
    i, j = (np.concatenate([p[k] for p in links]) if links else np.zeros(0, int) for k in (0, 1))
    np.add.at(n, i, copies[j])
    np.add.at(n, j, copies[i])
    root = rank.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[order[root]]
        if (root == before).all():
            break
    out = pd.DataFrame({"class": ids, "n": n, "root": ids[order[root]]})
    return out[out["n"] > 0]


def _cells(dims: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])
        held: list[pd.DataFrame] = []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(_compare(pd.concat(held), dims, least), schema, preserve_index=False)

        for batch in batches:
            rows = batch.to_pandas()
            for _, part in rows.groupby((rows[["leaf", "a", "b"]] != rows[["leaf", "a", "b"]].shift()).any(axis=1).cumsum()):
                same = held and (held[0][["leaf", "a", "b"]].iloc[0] == part[["leaf", "a", "b"]].iloc[0]).all()
                if held and not same:
                    yield done()
                    held.clear()
                held.append(part)
        if held:
            yield done()

    return run


def _placed(classes: DataFrame, dims: int, trees: int, least: float, leaf: int, spill: float) -> tuple[DataFrame, np.ndarray]:
    """Each class with its ``ball`` (or -1) and its leaves of the first cuts; and the balls' centres."""
    spark = classes.sparkSession
    sample = [r.vector for r in classes.orderBy(F.xxhash64("key"), "key").select("vector").limit(SAMPLE).collect()]
    x = _units(np.array(sample, np.float64).reshape(len(sample), dims))
    centres = find_balls(x[:BALL_SAMPLE], least)
    half = np.sqrt((1 + least) / 2) + 1e-9
    weight = classes.count() / max(1, len(x))
    rest = x[~(x @ centres.T >= half).any(axis=1)] if len(centres) else x
    levels = max(1, int(np.ceil(2 * np.log2(max(2, len(rest) * weight / leaf)))))
    forest = [(t, fit_cuts(rest, t, min(levels, 16), weight, leaf, spill)) for t in range(trees)]
    shared = spark.sparkContext.broadcast((forest, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, centres = shared.value
        for batch in batches:
            x = _units(_rows(batch.column("vector"), dims))
            found: list[list[int]] = [[] for _ in range(len(x))]
            for t, cuts in forest:
                for rows, node in walk(x, t, cuts, spill):
                    for r in rows.tolist():
                        found[r].append(node)
            ball, cosine = np.full(len(x), -1), np.zeros(len(x))
            if len(centres) and len(x):
                near = x @ centres.T
                cosine = near.max(axis=1)
                ball = np.where(cosine >= half, near.argmax(axis=1), -1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ball, pa.int64()), pa.array(cosine), pa.array([sorted(f) for f in found], pa.list_(pa.int64()))],
                [*batch.schema.names, "ball", "cosine", "nodes"],
            )

    schema = f"class long, copies long, least long, key binary, vector {classes.schema['vector'].dataType.simpleString()}"
    return classes.select("class", "copies", "least", "key", "vector").mapInArrow(run, f"{schema}, ball long, cosine double, nodes array<long>"), centres


def _cut_again(placed: DataFrame, big: DataFrame, dims: int, leaf: int, spill: float) -> DataFrame:
    """Leaves of too many vectors, each with cuts fitted on a bounded sample of its own."""
    members = placed.select("class", "key", "vector", "ball", F.explode("nodes").alias("node")).join(big, "node")
    by_hash = Window.partitionBy("node").orderBy(F.xxhash64("key"), "key")
    sample = members.where("ball < 0").withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= CELL)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = _units(np.vstack(rows["vector"].to_numpy()).astype(np.float64))
        node, n = int(rows["node"].iloc[0]), int(rows["size"].iloc[0])
        return pd.DataFrame({"node": [node], "cuts": [fit_cuts(x, node, LEVELS, n / len(x), leaf, spill).ravel().tolist()]})

    cuts = sample.select("node", "size", "vector").groupBy("node").applyInPandas(fit, "node long, cuts array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cuts = _units(_rows(batch.column("vector"), dims)), _rows(batch.column("cuts"), 2 * (2**LEVELS - 1))
            nodes, classes = batch.column("node").to_numpy(), batch.column("class").to_numpy()
            out: list[tuple[np.ndarray, int]] = []
            for node in np.unique(nodes).tolist():
                mine = np.flatnonzero(nodes == node)
                out += [(classes[mine[r]], leaf) for r, leaf in walk(x[mine], node, cuts[mine[0]].reshape(-1, 2), spill)]
            if out:
                moved = [pa.array(np.concatenate([c for c, _ in out])), pa.array(np.repeat([n for _, n in out], [len(c) for c, _ in out]))]
                yield pa.RecordBatch.from_arrays(moved, ["class", "node"])

    moved = members.drop("key").join(parked(cuts, "cuts"), "node").select("class", "node", "vector", "cuts").mapInArrow(run, "class long, node long")
    kept = placed.select("class", F.explode("nodes").alias("node")).join(big, "node", "left_anti")
    nodes = kept.unionByName(moved).groupBy("class").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    return placed.drop("nodes").join(nodes, "class")


def _forest(classes: DataFrame, dims: int, trees: int, least: float, leaf: int, cell: int, spill: float) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Classes with all their leaves, the balls' centres, and the leaves' sizes without and with balls."""
    placed, centres = _placed(classes, dims, trees, least, leaf, spill)
    placed, before = parked(placed, "leaves"), None
    for _ in range(ROUNDS):
        sizes = placed.select(F.explode("nodes").alias("node"), "ball").groupBy("node").agg(
            F.count_if(F.col("ball") < 0).alias("size"), F.count_if(F.col("ball") >= 0).alias("hot")
        )
        sizes = parked(sizes, "leaf-sizes")
        big = sizes.where(F.col("size") > cell).select("node", "size")
        # Leaves that no cut parts keep their name and size.
        seen = big.agg(F.count(F.lit(1)), F.sum("size"), F.bit_xor("node")).head()
        if not seen[0] or seen == before:
            break
        before, placed = seen, parked(_cut_again(placed, big, dims, leaf, spill), "leaves")
    return placed, centres, sizes


def _dealt(placed: DataFrame, sizes: DataFrame, cell: int) -> DataFrame:
    """Rows of the cells of all leaves: parts of at most ``cell`` vectors, each pair of parts a cell.

    Vectors outside balls meet each other and those in balls; those in balls do not meet each other here.
    """
    def parts(n: str):
        return F.greatest(F.ceil(F.col(n) / cell), F.lit(1)).cast("int")

    def places(n):
        return F.sequence(F.lit(0), n - 1)

    rows = placed.select("class", "copies", "vector", "ball", "nodes", F.explode("nodes").alias("leaf")).join(
        sizes.select(F.col("node").alias("leaf"), parts("size").alias("p"), F.when(F.col("hot") > 0, parts("hot")).otherwise(0).alias("q"), "size"), "leaf"
    )
    free = F.col("ball") < 0
    part = F.pmod(F.xxhash64("class"), F.when(free, F.col("p")).otherwise(F.greatest("q", F.lit(1)))).cast("int")
    rows = rows.where("size > 0").withColumn("part", part)
    met = F.transform(places(F.col("p")), lambda k: F.struct(
        F.least(k, F.col("part")).alias("a"), F.greatest(k, F.col("part")).alias("b"), (k < F.col("part")).cast("int").alias("side")))
    hot = F.when(F.col("q") > 0, F.transform(places(F.col("q")), lambda k: F.struct(F.col("part").alias("a"), (-1 - k).alias("b"), F.lit(0).alias("side"))))
    mine = F.when(free, F.concat(met, F.coalesce(hot, F.array().cast("array<struct<a:int,b:int,side:int>>")))).otherwise(
        F.transform(places(F.col("p")), lambda k: F.struct(k.alias("a"), (-1 - F.col("part")).alias("b"), F.lit(1).alias("side")))
    )
    return rows.select("leaf", F.inline(mine), F.lit(False).alias("whole"), "class", "copies", "vector", "ball", "nodes")


def near_duplicates(
    vectors: DataFrame, key: str, vector: str, least: float = COSINE, trees: int = TREES, leaf: int = LEAF, cell: int = CELL, spill: float = SPILL,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each row of ``vectors``.

    A link is a pair found with a cosine of ``least`` or more; pairs below never link. ``n_links`` counts other rows
    that a row links with directly, ``component_id`` is the smallest id reachable by links, and ``kept`` marks it. Links
    may be missed only where no tree keeps a pair together: near the threshold, hardly among copies.

    Vectors that are null, zero or empty, or hold null or non-finite components, link with nothing. Shorter vectors
    count as if filled up with zeros. Repeated rows are vectors of their own, so equal vectors link. A null id stays
    null, is no component's id unless alone, and is not kept. Other columns are not read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    # Floats travel as floats; all arithmetic on them is in doubles.
    kind = "array<float>" if vectors.schema[vector].dataType == ArrayType(FloatType()) else "array<double>"
    read = boxed(vectors, id=F.col(f"`{key}`").cast("long"), vector=F.col(f"`{vector}`").cast(kind)).select("id", "vector")
    rows = parked(read.mapInArrow(_keyed, f"id long, vector {kind}, key binary"), "vectors")
    valid = rows.where("key is not null")
    dims = valid.agg(F.max(F.size("vector"))).head()[0] or 1
    padded = F.concat("vector", F.array_repeat(F.lit(0), F.lit(dims) - F.size("vector")).cast(kind))
    classes = valid.groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first(padded).alias("vector")
    )
    classes = parked(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    placed, centres, sizes = _forest(classes, dims, trees, least, leaf, cell, spill)
    dealt = _dealt(placed, sizes, cell)

    # Balls: members of one link with each other, members of two by their centres' distance or by comparison.
    wide = float(np.arccos(least))
    summed = placed.where("ball >= 0").groupBy("ball").agg(
        F.sum("copies").alias("n"), F.count(F.lit(1)).alias("size"), F.min("class").alias("first"), F.min("cosine").alias("cosine")
    )
    known = {r.ball: (r.n, r.size, r.first, float(np.arccos(min(1.0, r.cosine))) + 1e-7) for r in summed.collect()}
    more: list[tuple] = [(b, n, first) for b, (n, _, first, _) in known.items()]
    meet: list[tuple] = []
    for b, (n, size, first, radius) in known.items():
        for c, (m, other, its_first, its_radius) in known.items():
            angle = float(np.arccos(np.clip(centres[b] @ centres[c], -1, 1)))
            if b == c or angle - radius - its_radius > wide:
                continue
            if angle + radius + its_radius <= wide:
                more.append((b, m, min(first, its_first)))
            else:
                meet.append((b, min(b, c) * len(centres) + max(b, c), int(b > c), -(-size // cell), -(-other // cell)))
    by_ball = placed.where("ball >= 0").select("class", "copies", "ball").join(
        F.broadcast(spark.createDataFrame(more, "ball long, m long, first long")), "ball"
    ).groupBy("class").agg((F.sum("m") - F.first("copies")).alias("n"), F.collect_set("first").alias("roots"))
    if meet:
        pairs = spark.createDataFrame(meet, "ball long, leaf long, side int, own int, others int")
        part = F.pmod(F.xxhash64("class"), F.col("own")).cast("int")
        both = placed.where("ball >= 0").join(F.broadcast(pairs), "ball").withColumns(
            {"part": part, "k": F.explode(F.sequence(F.lit(0), F.col("others") - 1))}
        )
        # Cells of pairs of balls have names that no pair of parts has: b is negative, both sides are in balls.
        place = [F.when(F.col("side") == 0, F.col("part")).otherwise(F.col("k")), F.when(F.col("side") == 0, F.col("k")).otherwise(F.col("part"))]
        dealt = dealt.unionByName(both.select(
            "leaf", place[0].alias("a"), (-1_000_000 - place[1]).alias("b"), "side", F.lit(True).alias("whole"),
            "class", "copies", "vector", "ball", "nodes",
        ))
    cells = dealt.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b").mapInArrow(_cells(dims, least), "class long, n long, root long")
    cells = parked(cells, "leaf-links")
    stars = cells.select("class", "root").unionByName(by_ball.select("class", F.explode("roots").alias("root")))
    roots = components(stars.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")).distinct())
    counted = cells.select("class", "n").unionByName(by_ball.select("class", "n")).groupBy("class").agg(F.sum("n").alias("n"))
    found = (
        placed.select("class", "key", "copies", "least").join(counted, "class", "left")
        .join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select("key", "least", F.coalesce("root", "class").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    found = parked(found, "found")
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"))
    found = found.join(ids, "root").select("key", "n_links", "component_id")
    component = F.coalesce("component_id", "id")
    return rows.select("id", "key").join(found, "key", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
