"""What the near-duplicate stage of the pipeline writes beside its result."""

import os
import random
import re
import time
import uuid

import numpy as np
from pyspark.sql import functions as F

from leadloom.llm import simhash
from leadloom.llm.common import CLEANUP, parked
from leadloom.session import shared_dir


def size_below(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_candidates_are_checked_without_copies_of_their_texts(spark, monkeypatch):
    """One text has more near copies than are checked together; the texts themselves are not written down."""
    monkeypatch.setattr(simhash, "TOGETHER", 3, raising=False)
    draw = random.Random(3)
    fresh = lambda n: [uuid.UUID(int=draw.getrandbits(128)).hex for _ in range(n)]
    rows = []
    for family in range(4):
        words = fresh(500)
        for i in range(20):
            rows.append((family * 100 + i, " ".join([*words[: 20 * i], *fresh(1), *words[20 * i + 1 :]])))
    rows += [(1000 + i, " ".join(fresh(500))) for i in range(10)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = size_below(f"{shared_dir(spark)}/parked")
    kept = simhash.keep_one_similar(docs, "doc_id", "text").collect()
    assert {r.doc_id for r in kept} == {0, 100, 200, 300, *range(1000, 1010), 2000}
    assert size_below(f"{shared_dir(spark)}/parked") - before < sum(len(t or "") for _, t in rows) / 2


def test_unlike_candidates_are_ruled_out_by_their_sketches(spark, monkeypatch):
    """Texts of one rare line and otherwise their own words are candidates by that line; their texts are not sent."""
    read = spark.sparkContext.accumulator(0)

    def counted(*args, plain=simhash._similar):
        run = plain(*args)

        def rows(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield from run(iter([batch]))

        return rows

    monkeypatch.setattr(simhash, "_similar", counted)
    draw = random.Random(5)
    fresh = lambda n: [uuid.UUID(int=draw.getrandbits(128)).hex for _ in range(n)]
    line = fresh(30)
    rows = [(i, " ".join([*fresh(100), *line, *fresh(100)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.keep_one_similar(docs, "doc_id", "text").count() == len(rows)
    assert read.value == 0


def test_sketches_rule_out_no_similar_sets():
    draw = np.random.default_rng(8)
    for _ in range(2000):
        n, least = int(draw.integers(0, 700)), draw.choice([0.5, 0.8, 0.95])
        a = np.unique(draw.integers(0, 2**63, n, np.uint64))
        b = np.union1d(a[draw.random(len(a)) < draw.uniform(0.75, 1)], draw.integers(0, 2**63, int(draw.integers(0, 1 + n // 5)), np.uint64))
        if simhash.jaccard(a, b) >= least:
            assert simhash.may_be_similar(simhash.sketch(a), len(a), simhash.sketch(b), len(b), least)


def test_index_copies_do_not_jump_with_the_documents():
    """Each further block multiplies the rows of all fingerprints: 21 copies up to five million, not 56 from 1.3 million on."""
    assert [simhash.choose_blocks(n, simhash.PRINT_BITS) for n in (1, 250_000, 3_000_000, 5_000_000, 10**9)] == [7, 7, 7, 7, 9]


def test_shuffle_files_go_with_the_write(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString("\n")))
    before = files()
    parked(spark.range(10_000).repartition(8, F.col("id") % 100), "dealt")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(CLEANUP) == "false"
