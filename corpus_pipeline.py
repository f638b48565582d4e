"""Corpus pipeline: documents in, token counts and digests of the mixed corpus out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlsift.llm import bpe, lines, mixing, neardup, toxicity
from crawlsift.llm.storage import saved

#: In order; each takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", lines.stage),
    ("ngram_join", neardup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: The classifier, the approximate candidate search and the tokenizer are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
