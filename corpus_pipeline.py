"""The corpus pipeline: quality, boilerplate lines, near-duplicates, benchmark passages, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import classifier, decontaminate, line_dedup, packing, simhash
from leadloom.llm.queries import KEEP_SCORE, quality_model, table, tokenizer_path
from leadloom.session import shared_dir

#: SQL cannot express the trained classifier of the first stage.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at the threshold or above."""
    model = quality_model(spark, sf_dir)
    return docs.where(classifier.score(model, F.col("text")) >= KEEP_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their site; those that held nothing else stay, empty.

    Copies are one page: they would make their own text boilerplate before one of them is kept.
    """
    return line_dedup.drop_site_lines(docs, "source", "text", copies=False).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id.

    Near are texts that have at least 0.8 of their distinct five-word shingles in common; each link is checked on whole texts.
    """
    return simhash.keep_one_similar(docs, "doc_id", "text")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_items(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: token ids of what is left."""
    return packing.pack(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates),
    ("decontamination", benchmark), ("packing", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
