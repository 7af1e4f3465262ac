"""Training sequences by power-of-two decomposition.

Each document's tokens are cut into pieces whose lengths are powers of two: as many of the
full length as fit, then one for each bit of what is left. A piece is a sequence of its
own. Batches are drawn from sequences of one length (its bucket), so nothing is padded and
no sequence crosses documents.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 1024
END_ID = 0
#: How a byte-level tokenizer cuts text before it merges bytes.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TokenBytes:
    """Ids of a text as little-endian unsigned 32-bit integers.

    The ids are those of the tokenizer file. Where it is a plain byte-level one, whose ids
    stand in the order of its merges, a faster library with the same ranks finds them; texts
    with its special tokens, and all texts of other tokenizers, take the slower way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.fast = self._ranked(json.load(f))

    @staticmethod
    def _ranked(file: dict):
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        vocab, merges = model.get("vocab", {}), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        plain = (
            model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
            and not (cut.get("add_prefix_space") or file.get("normalizer") or model.get("dropout"))
            and not (model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        )
        ranks = [vocab["".join(m)] for m in merges] if plain else []
        if not ranks or any(a >= b for a, b in itertools.pairwise(ranks)):
            return None
        import tiktoken

        byte_of, added = _byte_of(), {t["content"] for t in file.get("added_tokens", [])}
        known = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
        return tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=known, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TokenBytes(path)


def piece_lengths(tokens: int, longest: int = MAX_TOKENS) -> list[int]:
    """Powers of two, largest first, that add up to ``tokens``."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _pack(path: str, longest: int, end_id: int, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_bytes(path)
        sequence = TaskContext.get().partitionId() << 40
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                owner, starts, lengths, ids, totals = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    all_ids = encode(text or "") + end
                    total, at = len(all_ids) // 4, 0
                    for n in piece_lengths(total, longest):
                        owner.append(i)
                        starts.append(at)
                        lengths.append(n)
                        ids.append(all_ids[4 * at : 4 * (at + n)])
                        totals.append(total)
                        at += n
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner, pa.int64())).cast(key_type),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(totals, pa.int64()),
                        pa.array(range(sequence, sequence + len(owner)), pa.int64()),
                    ],
                    names=["key", "start", "length", "ids", "doc_tokens", "sequence_id"],
                )
                sequence += len(owner)

    return run


def pack(
    docs: DataFrame, key: str, text: str, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """One row for each piece of each document.

    Columns: ``key`` under its own name; ``start``, its document's ids before it; ``length``;
    ``ids``, binary, unsigned 32-bit little-endian; ``doc_tokens`` with the closing id;
    ``sequence_id``; ``offset`` in the sequence, always 0; ``bucket``, the binary logarithm of the length.

    ``tokenizer`` is a path that every executor can read. ``max_tokens`` must be a power of two.
    Everything is local to the row: nothing is shuffled. Sequence ids are unique; they
    follow the partitions of the input. A null or empty text is the closing id alone. Rows
    with a null or repeated key are packed like any other. Other columns are not looked at.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    out = rows.mapInArrow(
        _pack(tokenizer, max_tokens, end_id, to_arrow_type(kind)),
        f"key {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long",
    )
    return out.select(
        F.col("key").alias(key), "start", "length", "ids", "doc_tokens", "sequence_id",
        F.lit(0).cast("long").alias("offset"), F.round(F.log2("length")).cast("int").alias("bucket"),
    )
