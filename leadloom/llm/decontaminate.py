"""Benchmark passages in documents, found with an error budget.

A test item may differ in ``k`` characters from a passage and still be a leak. Cut into
``k + 1`` pieces, at least one of them then stands in the passage unchanged. All pieces are
looked for at once by an automaton. Each hit says where the item would lie. Neighbouring pieces are
put together two by two, with a budget of one less than their pieces, and a hit is followed upwards as long as
the passage around it is within that budget (Navarro, Baeza-Yates 1999): where all edits are
within the budget of a node, those of one of its halves are within the budget of that half. Edit distances
are computed with bit-parallel columns (Myers 1999).

An item of which a text holds only the beginning or the end is found by its first and last three quarters.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import parked

#: Share of an item's characters that may differ.
ERROR_RATE = 0.1
#: Items shorter than this are looked for as they are, between blanks: edited, they say too little to be told from chance.
MIN_CHARS = 40
#: Share of an item that is a leak if the rest is cut off, where that leaves ``MIN_CHARS`` and more.
CUT_SHARE = 0.75
#: Characters of items that are searched for in one pass over the documents.
BLOCK_CHARS = 1_000_000


def plain(text: str | None) -> str:
    """Lower case, one blank between words."""
    return " ".join((text or "").lower().split())


def pieces(text: str, parts: int) -> list[tuple[int, str]]:
    """``text`` cut into so many parts of nearly equal length, each with its place."""
    cuts = [len(text) * i // parts for i in range(parts + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Pattern:
    """A text to be found anywhere in another at the least edit distance."""

    def __init__(self, text: str):
        self.size, self.all = len(text), (1 << len(text)) - 1
        self.at: dict[str, int] = {}
        for i, c in enumerate(text):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def best(self, text: str, lo: int, hi: int, step: int = 1, anchored: bool = False) -> tuple[int, int]:
        """``distance, place`` of the least distance of a passage of ``text[lo:hi]``.

        The place is that of its last character, the first such one. With ``step`` -1 the text
        is read backwards. An ``anchored`` passage begins at the first character read.
        """
        at, last, full = self.at, 1 << (self.size - 1), self.all
        plus, minus, score = full, 0, self.size
        best, place = score, None
        carry = 1 if anchored else 0
        for i in range(lo, hi) if step > 0 else range(hi - 1, lo - 1, -1):
            eq = at.get(text[i], 0)
            vertical = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(across | plus) & full
            down = plus & across
            if up & last:
                score += 1
            elif down & last:
                score -= 1
            up, down = (up << 1 | carry) & full, down << 1 & full
            plus = down | ~(vertical | up) & full
            minus = up & vertical
            if score < best:
                best, place = score, i
        return best, place


class Needle:
    """A text that is looked for: an item, or what is left of it when an end is cut off."""

    def __init__(self, item: int, text: str, budget: int, missing: int = 0, between_blanks: bool = False):
        self.item, self.text, self.budget, self.missing, self.between_blanks = item, text, budget, missing, between_blanks
        self.leaves = pieces(text, budget + 1)
        self.patterns: dict[tuple[int, int], Pattern] = {}
        self.paths: dict[int, tuple[list[str], list[tuple[int, int, int]]]] = {}
        self.backward: Pattern | None = None

    def pattern(self, lo: int, hi: int) -> Pattern:
        if (lo, hi) not in self.patterns:
            self.patterns[lo, hi] = Pattern(self.text[lo:hi])
        return self.patterns[lo, hi]

    def path(self, leaf: int) -> tuple[list[str], list[tuple[int, int, int]]]:
        """What must be near a leaf that was hit.

        First parts of the rest of the lowest node above it, one more than the node's budget, of which one is there unchanged;
        then ``begin, end, budget`` of the nodes above, without the root, upwards.
        """
        if leaf not in self.paths:
            nodes, lo, hi = [], 0, len(self.leaves)
            while hi - lo > 1:
                if hi - lo < len(self.leaves):
                    at, last = self.leaves[hi - 1]
                    nodes.append((self.leaves[lo][0], at + len(last), hi - lo - 1))
                middle = (lo + hi) // 2
                lo, hi = (lo, middle) if leaf < middle else (middle, hi)
            rest = []
            if nodes:
                begin, end, budget = nodes[-1]
                at, piece = self.leaves[leaf]
                # The leaf is one side of the node's cut, so the rest is in one piece.
                other = self.text[at + len(piece) : end] if at == begin else self.text[begin:at]
                rest = [part for _, part in pieces(other, budget + 1)]
            self.paths[leaf] = rest, nodes[::-1]
        return self.paths[leaf]

    def may_hold(self, text: str, leaf: int, start: int, known: dict) -> bool:
        """Whether every node above a leaf that was hit is within its budget where the needle would begin at ``start``."""
        rest, nodes = self.path(leaf)
        for lo, hi, budget in nodes:
            key = lo, hi, start
            if key not in known:
                begin, end = max(0, start + lo - budget), min(len(text), start + hi + budget)
                if rest and all(text.find(part, begin, end) < 0 for part in rest):
                    return False
                known[key] = self.pattern(lo, hi).best(text, begin, end)[0] <= budget
            rest = []
            if not known[key]:
                return False
        return True

    def verify(self, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        """``distance, start, end`` of the best passage of ``text[lo:hi]``, if it is within the budget."""
        at = text.find(self.text, lo, hi)
        if at >= 0:
            return 0, at, at + len(self.text)
        distance, end = self.pattern(0, len(self.text)).best(text, lo, hi)
        if end is None or distance > self.budget:
            return None
        self.backward = self.backward or Pattern(self.text[::-1])
        _, start = self.backward.best(text, max(lo, end + 1 - len(self.text) - self.budget), end + 1, -1, anchored=True)
        return distance, start, end + 1


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[list, str]], rate: float, min_chars: int = MIN_CHARS, share: float = CUT_SHARE):
        import ahocorasick

        self.items = items
        self.needles: list[Needle] = []
        for n, (_, text) in enumerate(items):
            if len(text) < min_chars:
                self.needles.append(Needle(n, text, 0, between_blanks=True))
                continue
            self.needles.append(Needle(n, text, int(len(text) * rate)))
            size = math.ceil(len(text) * share)
            if size >= min_chars and size < len(text):
                for part in (text[:size], text[-size:]):
                    self.needles.append(Needle(n, part, int(size * rate), len(text) - size))
        found: dict[str, list[tuple[int, int, int]]] = {}
        for n, needle in enumerate(self.needles):
            for leaf, (at, piece) in enumerate(needle.leaves):
                found.setdefault(piece, []).append((n, leaf, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def _passages(self, text: str) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """Needles with passages of the text that are within their budget, each the best of its surroundings."""
        places: dict[int, set[int]] = {}
        known: dict[int, dict] = {}
        for last, (size, of) in self.automaton.iter(text):
            for n, leaf, at in of:
                needle, start = self.needles[n], last + 1 - size - at
                if needle.between_blanks:
                    end = last + 1
                    if (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " "):
                        yield n, (0, start, end)
                elif start not in places.setdefault(n, set()) and needle.may_hold(text, leaf, start, known.setdefault(n, {})):
                    places[n].add(start)
        for n in sorted(places):
            needle, window = self.needles[n], None
            for start in [*sorted(places[n]), None]:
                # Places whose passages overlap are looked at together.
                if window and (start is None or start - needle.budget > window[1]):
                    found = needle.verify(text, max(0, window[0]), min(len(text), window[1]))
                    if found:
                        yield n, found
                    window = None
                if start is not None:
                    window = (window[0] if window else start - needle.budget, start + len(needle.text) + needle.budget)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``item, distance, start, end`` of the best passage of each item that is there.

        Of an item cut at an end, the characters cut off count as edits.
        """
        if not self.needles or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        for n, (distance, start, end) in self._passages(text):
            needle = self.needles[n]
            passage = distance + needle.missing, start, end
            best[needle.item] = min(best.get(needle.item, passage), passage)
        return [(n, *best[n]) for n in sorted(best)]


#: Matchers a worker keeps at a time.
MATCHERS = 2
_built: dict[str, Matcher] = {}


class Search:
    """A block of items as it is sent to the workers."""

    def __init__(self, spark: SparkSession, block: list[tuple[list, str]], rate: float, min_chars: int):
        self.token, self.rate, self.min_chars = uuid.uuid4().hex, rate, min_chars
        self.block = spark.sparkContext.broadcast(block)

    def matcher(self) -> Matcher:
        """The block's matcher, built once in a worker as long as few blocks are in use."""
        if self.token not in _built:
            while len(_built) >= MATCHERS:
                del _built[next(iter(_built))]
            _built[self.token] = Matcher(self.block.value, self.rate, self.min_chars)
        return _built[self.token]


def item_blocks(
    items: DataFrame, key: str, text: str, block_chars: int = BLOCK_CHARS
) -> Iterator[list[tuple[list, str]]]:
    """The items in blocks of bounded size: their ids and normalised text, equal texts once.

    Items reach the driver a partition at a time, and one block is held at a time. Equal
    texts in different blocks are told apart by nothing but that, and give the same rows.
    """
    block, size = {}, 0
    rows = items.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        body = plain(row["text"])
        if not body:
            continue
        if size and size + len(body) > block_chars:
            yield [(ids, t) for t, ids in sorted(block.items())]
            block, size = {}, 0
        size += 0 if body in block else len(body)
        block.setdefault(body, []).append(row["key"])
    if block:
        yield [(ids, t) for t, ids in sorted(block.items())]


def find_items(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str,
    rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """A row for each document and item of which it holds a passage within the error budget.

    Columns ``doc_key, item_key, distance, start, end``: the best passage (least distance, then the
    first), in characters of the document's text in lower case with single blanks. The
    budget is ``rate`` times the item's length, rounded down. Items shorter than
    ``min_chars`` are found unchanged and between blanks only. An item also counts if its first or last ``CUT_SHARE``
    is there within the budget of that part; the characters cut off then count as edits in ``distance``. Items without a word
    are left out. Documents are read once for each block of items, whole.

    Null and empty texts hold nothing. Rows with a null or repeated key are searched like any
    other, and repeated items each give their rows. Other columns are not looked at. Empty
    tables give an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind, item_kind = rows.schema["key"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc_key {kind}, item_key {item_kind}, distance int, start int, end int"
    out = []
    for block in item_blocks(items, item_key, item_text, block_chars):
        sent = Search(spark, block, rate, min_chars)

        def search(batches: Iterator[pa.RecordBatch], sent: Search = sent) -> Iterator[pa.RecordBatch]:
            matcher = sent.matcher()
            for batch in batches:
                owner, found = [], []
                for i, body in enumerate(batch.column(1)):
                    for n, *passage in matcher.find(plain(body.as_py())):
                        for item in matcher.items[n][0]:
                            owner.append(i)
                            found.append((item, *passage))
                columns = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=["doc_key", "item_key", "distance", "start", "end"],
                )

        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(items.schema[item_key].dataType), pa.int32(), pa.int32(), pa.int32()]
        out.append(parked(rows.mapInArrow(search, schema), "passages"))
    if not out:
        return spark.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionByName, out)


def holds_item(text: Column, sent: Search) -> Column:
    """Whether a text holds a passage of an item of the block."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        matcher = sent.matcher()
        return pd.Series([bool(matcher.find(plain(t))) for t in texts], dtype=bool)

    return run(text)


def without_items(
    docs: DataFrame, text: str, items: DataFrame, item_key: str, item_text: str,
    rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that hold no item; columns as they were. Texts and items as in ``find_items``.

    What no block so far has found goes on to the next ones; it is written after every few blocks.
    """
    for n, block in enumerate(item_blocks(items, item_key, item_text, block_chars)):
        if n and n % MATCHERS == 0:
            docs = parked(docs, "clean")
        docs = docs.where(~holds_item(F.col(text).cast("string"), Search(docs.sparkSession, block, rate, min_chars)))
    return docs
