"""Copies in a source are one page for its boilerplate lines."""

import corpus_pipeline


def test_copies_keep_one_full_text(spark):
    text = "\n".join(f"line {i} of a page that was copied to fifty places" for i in range(8))
    rows = [(i, text, "s") for i in range(50)]
    rows += [(100 + i, f"menu of the site\nwords of page {i} and {i * i} and {i * 7} that no other page has", "s") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = corpus_pipeline.lines(spark, docs, "")
    assert left.count() == 70 and left.where("text LIKE '%menu%'").count() == 0
    kept = corpus_pipeline.near_duplicates(spark, left, "").collect()
    assert [r.doc_id for r in kept if r.text == text] == [0]
