"""A supervised text classifier on subword embeddings.

A document is the mean of learned vectors, one for each of its words and for each run of
three to five characters of a word (with its ends marked), looked up by hash; a word that
repeats the one before it also counts as "again". A softmax layer
turns the mean into probabilities. Vectors and layer are trained by stochastic gradient
descent in numpy (Joulin, Grave, Bojanowski, Mikolov 2016). For scoring, both are folded into
one number for each hash, whose mean is the difference of the two logits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled rows a model is fitted on: so many of each class at most, those with the least hashes.
MAX_ROWS_OF_CLASS = 1000
BITS = 17
GRAMS = (3, 4, 5)
#: The bucket that all words share which repeat the word before them.
AGAIN = 0
#: Features of no weight that every text has beside its own, so that a few words decide little.
BLANKS = 30
#: Characters that are turned into features at a time; a longer text is one such step.
STEP = 1 << 19
_MIX = np.uint32(2654435761)


def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= _MIX
    h ^= h >> np.uint32(13)
    h *= _MIX
    return h >> np.uint32(32 - bits)


def features(texts: list[str], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays ``doc, bucket``, a few for each call; together every feature of every text."""
    c = np.frombuffer("".join(t + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    space = (c == 32) | ((c >= 9) & (c <= 13))
    keep = np.concatenate([[True], ~(space[1:] & space[:-1])]) if len(c) else space
    c, doc, space = np.where(space, np.uint32(32), c)[keep], doc[keep], space[keep]
    c, space = np.concatenate([[np.uint32(32)], c]), np.concatenate([[True], space])
    doc = np.concatenate([doc[:1], doc])
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(first):
        return
    # A word's hash: its characters times powers of an odd number, added up.
    word_of = np.cumsum(space[:-1] & ~space[1:]) - 1
    place = np.arange(1, len(c)) - first[np.maximum(word_of, 0)]
    powers = np.cumprod(np.full(int(np.diff(np.append(first, len(c))).max()) + 2, 0x9E3779B1 | 1, np.uint32), dtype=np.uint32)
    term = np.where(space, np.uint32(0), c)
    term[1:] *= powers[np.maximum(place, 0)]
    words = np.add.reduceat(term, first, dtype=np.uint32)
    yield doc[first], _buckets(words, bits)
    again = np.flatnonzero((words[1:] == words[:-1]) & (doc[first][1:] == doc[first][:-1])) + 1
    yield doc[first[again]], np.full(len(again), AGAIN, np.uint32)
    spaces = np.cumsum(space, dtype=np.int32)
    h = c * np.uint32(0x85EBCA6B)
    for n in range(2, max(GRAMS) + 1):
        if len(c) < n:
            return
        h = (h[:-1] ^ (h[:-1] >> np.uint32(16))) * np.uint32(0xC2B2AE35) + c[n - 1 :]
        if n in GRAMS:
            inside = spaces[n - 2 : len(c) - 1] == spaces[: len(c) - n + 1]
            yield doc[1 : len(c) - n + 2][inside], _buckets(h[inside] + np.uint32(n), bits)


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STEP:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def counted(texts: list[str], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and their shares of its features."""
    for text in texts:
        found = [b for _, b in features([text], bits)]
        ids, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
        yield ids.astype(np.int32), (n / (n.sum() + BLANKS)).astype(np.float32)


@dataclass
class Model:
    """``weight`` of each bucket and ``bias``: the logit is the bias plus the mean weight (blanks weigh 0)."""

    weight: np.ndarray
    bias: float
    bits: int = BITS

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of class 1 for each text."""
        out = np.zeros(len(texts))
        for lo, hi in _steps(texts):
            total, count = np.zeros(hi - lo), np.zeros(hi - lo)
            for doc, bucket in features(texts[lo:hi], self.bits):
                total += np.bincount(doc, self.weight[bucket], hi - lo)
                count += np.bincount(doc, minlength=hi - lo)
            out[lo:hi] = total / (count + BLANKS)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -40, 40)))


def train(
    ids: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, counts: tuple[int, int] | None = None,
    bits: int = BITS, size: int = 16, steps: int = 3000, rate: float = 20.0, batch: int = 16, seed: int = 7,
) -> Model:
    """Stochastic gradient descent on the cross entropy of a two-class softmax.

    ``counts`` are the classes' numbers among all labelled rows; those of the sample by default.
    A class's rows weigh as much as it has in them, so scores are probabilities among all. With
    one class only, or none, there is nothing to learn: the model then gives the share
    of class 1 (a half without labels) for any text.
    """
    y = np.asarray(labels, np.int64)
    sampled = np.bincount(y, minlength=2)[:2]
    if not sampled.all():
        share = np.clip((sampled[1] + 0.5) / (sampled.sum() + 1), 0.01, 0.99)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), bits)
    of_class = np.asarray(counts or sampled) / sampled
    importance = (of_class / of_class[y].mean())[y].astype(np.float32)
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / size, 1 / size, (1 << bits, size)).astype(np.float32)
    layer, bias = np.zeros((size, 2), np.float32), np.zeros(2, np.float32)
    bias[1] = np.log(np.average(y, weights=importance) / (1 - np.average(y, weights=importance)))
    done = 0
    while done < steps:
        order = draw.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo : lo + batch]
            used, place = np.unique(np.concatenate([ids[i] for i in rows]), return_inverse=True)
            share = np.zeros((len(rows), len(used)), np.float32)
            owner = np.repeat(np.arange(len(rows)), [len(ids[i]) for i in rows])
            share[owner, place] = np.concatenate([shares[i] for i in rows])
            own = vectors[used]
            mean = share @ own
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= importance[rows][:, None] / len(rows)
            lr = rate * max(0.0, 1 - done / steps)
            # Plain steps for the layer; the vectors' gradients are shares of a mean and need the larger rate.
            vectors[used] = own - lr * (share.T @ (p @ layer.T))
            layer -= 0.05 * lr * (mean.T @ p)
            bias -= 0.005 * lr * p.sum(0)
            done += 1
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def sample_labels(labelled: DataFrame, key: str, label: str, most: int = MAX_ROWS_OF_CLASS) -> DataFrame:
    """At most ``most`` rows of each of the labels 0 and 1, those with the least hashes of their keys."""
    parts = []
    for value in (0, 1):
        rows = labelled.where((F.col(label) == value) & F.col(key).isNotNull())
        parts.append(rows.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(most))
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = MAX_ROWS_OF_CLASS) -> Model:
    """Fits a model on a bounded sample of labelled rows, ``2 * most`` at most.

    Rows without a key, a label of 0 or 1, or a document are left out; repeated labels count
    once, repeated documents as often as they stand there. Texts become hashed counts in the
    tasks; only those of the sample come to the driver.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    chosen = sample_labels(known, "key", "label", most)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 64):
                part = frame.iloc[lo : lo + 64]
                pairs = list(counted([t or "" for t in part["text"]]))
                yield pd.DataFrame(
                    {"label": part["label"].to_numpy(), "ids": [p[0].tobytes() for p in pairs], "shares": [p[1].tobytes() for p in pairs]}
                )

    joined = rows.join(F.broadcast(chosen), "key").select("label", "text")
    found = joined.mapInPandas(extract, "label int, ids binary, shares binary").toArrow()
    # The order of the rows is that of their contents, however the tasks came in.
    found = found.take(pa.array(np.argsort([zlib.crc32(x.as_buffer()) for x in found["shares"]], kind="stable")))
    counts = dict(known.where(F.col("label").isin(0, 1)).groupBy("label").count().collect())
    return train(
        [np.frombuffer(x.as_buffer(), np.int32) for x in found["ids"]],
        [np.frombuffer(x.as_buffer(), np.float32) for x in found["shares"]],
        found["label"].to_numpy(),
        (counts.get(0, 0), counts.get(1, 0)),
    )


def score(model: Model, text: Column) -> Column:
    """The model's probability of class 1; null and empty texts are scored by the bias alone."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([t or "" for t in texts]))

    return run(text)
