"""Line dedup, quality rules, classifier and packing."""

import collections
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from leadloom.llm import classifier, line_dedup, packing, quality_rules
from leadloom.llm.queries import tokenizer_path


def test_lines_follow_their_site(spark):
    rows = [(i, "a", f"own {i}\nmenu\n\nfoot ") for i in range(6)] + [(10 + i, "b", f"other {i}\nmenu") for i in range(100)]
    rows += [(200, "b", "rare\nfoot"), (201, None, "menu"), (202, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = {r.doc_id: r for r in line_dedup.drop_site_lines(docs, "source", "text", 0.5, 5).collect()}
    assert out[0].text == "own 0\n" and (out[0].n_lines, out[0].n_dropped) == (3, 2)
    assert out[10].text == "other 0" and out[200].text == "rare\nfoot"
    assert out[201].text == "menu" and out[202].text is None and out[202].n_lines == 0


def test_few_pages_hold_no_boilerplate(spark):
    docs = spark.createDataFrame([(1, "a", "same"), (2, "a", "same")], "doc_id long, source string, text string")
    assert [r.text for r in line_dedup.drop_site_lines(docs, "source", "text").collect()] == ["same", "same"]


def test_line_dedup_odd(odd, none):
    out = line_dedup.drop_site_lines(odd, "source", "text", 0.01, 2)
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns)
    assert line_dedup.drop_site_lines(none, "source", "text").count() == 0


def _measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_measures(spark, odd, none):
    texts = ["a b c d a b c", "a a a a", "a b c a b", "x y\nx y\n \nx y", "# $ %% z|", " lead tail "]
    docs = odd.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(50, t, "r") for t in texts], "doc_id long, text string, row string"))
    out = quality_rules.measures(docs, "text").select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(out) == docs.count()
    for r in out:
        assert tuple(r)[1:] == _measures(r.text or ""), r.text[:50]
    assert quality_rules.judge(none, "text").count() == 0
    judged = quality_rules.judge(docs, "text")
    assert judged.count() == docs.count() and judged.where("kept").count() == 0


def test_expectation_maximisation_against_numpy(spark):
    draw = np.random.default_rng(3)
    good = draw.random(4000) < 0.8
    rules = tuple(quality_rules.Vote(n, "true", "false") for n in "abcd")
    p_good, p_bad = np.array([0.02, 0.38, 0.6]), np.array([0.5, 0.3, 0.2])
    votes = np.where(good[:, None], draw.choice([-1, 0, 1], (4000, 4), p=p_good), draw.choice([-1, 0, 1], (4000, 4), p=p_bad))
    rows = [tuple(map(int, v)) for v in votes]
    found = quality_rules.estimate(spark.createDataFrame(rows, ", ".join(f"vote_{r.name} int" for r in rules)), rules, 12)
    share, table = 0.7, {0: np.tile(quality_rules.ON_GOOD, (4, 1)), 1: np.tile(quality_rules.ON_BAD, (4, 1))}
    for _ in range(12):
        a = np.log(share) + sum(np.log(table[0][j][votes[:, j] + 1]) for j in range(4))
        b = np.log(1 - share) + sum(np.log(table[1][j][votes[:, j] + 1]) for j in range(4))
        p = 1 / (1 + np.exp(b - a))
        for kind, w, guess in ((0, p, quality_rules.ON_GOOD), (1, 1 - p, quality_rules.ON_BAD)):
            sums = np.array([[w[votes[:, j] == v].sum() for v in (-1, 0, 1)] for j in range(4)]) + 10 * np.array(guess)
            table[kind] = sums / sums.sum(1, keepdims=True)
        share = p.mean()
    assert abs(found.good - share) < 1e-4
    assert np.allclose([found.votes[r.name][0] for r in rules], table[0], atol=1e-4)
    assert abs(found.good - 0.8) < 0.05 and found.accuracy("a")[0] > 0.9


def test_classifier_learns_and_takes_odd_texts(spark, odd, none):
    docs = [(i, ("BUY NOW!! " * (5 + i % 7)) if i % 3 == 0 else f"some plain words of page {i} " * (2 + i % 5)) for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(0, 300, 2)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = classifier.fit(table, labels, "doc_id", "text", "quality")
    scored = table.select("doc_id", classifier.score(model, F.col("text")).alias("s")).where("doc_id % 2 = 1").collect()
    assert all((r.s >= 0.7) == (r.doc_id % 3 != 0) for r in scored)
    again = classifier.fit(table, labels, "doc_id", "text", "quality")
    assert np.array_equal(model.weight, again.weight)
    assert all(0 <= r[0] <= 1 for r in odd.select(classifier.score(model, F.col("text"))).collect())
    assert classifier.fit(none, labels, "doc_id", "text", "quality").scores(["x"])[0] == 0.5


def test_batches_do_not_change_scores():
    texts = ["", "a", "b c b b", "x" * 3000, "end "]
    model = classifier.Model(np.random.default_rng(1).normal(size=1 << classifier.BITS).astype(np.float32), 0.1)
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])
    shares = list(classifier.counted(texts))
    assert np.allclose(1 / (1 + np.exp(-(model.weight[shares[2][0]] @ shares[2][1] + 0.1))), model.scores(texts)[2])


def test_packing_round_trip(spark, odd, none, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), "text")
    more = ["x <|endoftext|> y", "a  b\n\n c", "it's  we'll\t\tok", "\x1cfoo bar", "x  y", "12 345 ½²"]
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    pieces = packing.pack(docs, "doc_id", "text", tokenizer_path()).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    texts = dict(tuple(r) for r in docs.collect())
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for key, text in texts.items():
        own = sorted(by_doc[key], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist()
        assert ids == [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert all(p.length & (p.length - 1) == 0 and p.length == 1 << p.bucket <= 1024 and p.offset == 0 for p in own)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    out = packing.pack(odd, "doc_id", "text", tokenizer_path())
    assert out.where("start = 0").count() == odd.count()
    assert packing.pack(none, "doc_id", "text", tokenizer_path()).count() == 0
    assert out.select(F.crc32("ids").alias("c"), "ids").head().c == zlib.crc32(out.select("ids").head().ids)


def test_piece_lengths():
    assert packing.piece_lengths(2048 + 5) == [1024, 1024, 4, 1] and packing.piece_lengths(1) == [1]
