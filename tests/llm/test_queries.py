"""The registered corpus queries over the smallest tables."""

import re
import zlib

import numpy as np
import pytest
from oracle import connect, normal
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import decontaminate, queries, simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    found = connect(SF).execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, found.fetchall())


def test_held_out_accuracy(spark):
    scored = queries.op2_subword_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    assert all(r.predicted for r in rows if r.quality)


def test_components_against_brute_force(spark, docs):
    rows = {r.doc_id: r for r in queries.op4_gray_index(spark, SF).collect()}
    keys = sorted(rows)
    prints = np.array([simhash.fingerprint(docs[k]) for k in keys]).view(np.uint64)
    assert [rows[k].fingerprint for k in keys] == [f"{p:016x}" for p in prints]
    root = dict(zip(keys, keys))
    changed = True
    near = [[keys[j] for j in np.flatnonzero(np.bitwise_count(prints ^ p) <= 4)] for p in prints]
    while changed:
        changed = False
        for k, friends in zip(keys, near):
            least = min(root[f] for f in friends)
            changed |= least != root[k]
            root[k] = least
    assert {k: rows[k].component_id for k in keys} == root


def test_leaks_against_search(spark, docs):
    found = {(r.doc_id, r.item_id) for r in queries.op8_pigeonhole_edits(spark, SF).where("distance = 0").collect()}
    items = {r.item_id: decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in decontaminate.plain(t)}
    assert found == want and want


def test_passages_against_all_windows(spark, docs):
    rows = queries.op9_collinear_chains(spark, SF).collect()
    owners = {}
    for k, t in docs.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        for j in range(len(w) - 49):
            owners.setdefault(tuple(w[j : j + 50]), set()).add(k)
    want = set().union(*(o for o in owners.values() if len(o) > 1))
    assert want <= {r.doc_id for r in rows} | {r.partner_id for r in rows}
    assert all(r.words >= 50 and r.identity >= 0.8 for r in rows)


def test_kept_documents(spark):
    rows = queries.op5_weak_votes(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    judged = [r for r in rows if not r.base_failed]
    assert all(r.kept for r in judged if r.quality) and not any(r.kept for r in rows if not r.quality)


def similar_groups(texts, least=0.8):
    """Document to the least id of its group: texts that share enough five-word shingles, and what they connect."""
    def grams(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, holders, root = {k: grams(t) for k, t in texts.items()}, {}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in sorted(sets):
        met = {o for g in sets[k] for o in holders.get(g, ())} if sets[k] else {o for o in sets if o < k and not sets[o]}
        for o in met:
            if not sets[k] or len(sets[k] & sets[o]) >= least * len(sets[k] | sets[o]):
                a, b = sorted((find(k), find(o)))
                root[b] = a
        for g in sets[k]:
            holders.setdefault(g, []).append(k)
    return {k: find(k) for k in texts}


def test_pipeline(spark, docs):
    """Each stage beside what its operator says about the documents before it."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    table, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, table = table, stage(spark, table, SF).cache()
        assert table.columns == before.columns
        seen.append({r.doc_id: r.text for r in table.collect()})
    quality, lines, single, clean = seen
    scored = queries.op2_subword_quality(spark, SF).where("predicted = 1").collect()
    assert set(quality) == {r.doc_id for r in scored}
    assert set(lines) == set(quality) and any(lines[k] != quality[k] for k in lines)
    near = similar_groups(lines)
    assert set(single) <= set(near.values()) | set(single) and {near[k] for k in single} == set(near.values())
    least = {r for r in near.values()}
    assert least <= set(single) and len(set(single) - least) <= 0.05 * (len(lines) - len(least))
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(x in decontaminate.plain(t) for t in clean.values() for x in items)
    assert all(any(x in decontaminate.plain(single[k]) for x in items) for k in set(single) - set(clean))
    pieces = corpus_pipeline.pieces(spark, table, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(clean)
    assert pieces.where(F.col("length") != F.pow(F.lit(2), F.col("bucket"))).count() == 0
