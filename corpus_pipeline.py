"""A corpus pipeline over ``documents``: each stage takes what the one before kept.

Counted as part of the subpackage ``loomline.llm``. All stages but the last return the columns of
``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe_codec, decontamination, jaccard_join, line_dedup, quality_rules
from loomline.llm.common import whole_rows, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; each row is judged by itself."""
    return whole_rows(quality_rules.quality_rules(docs, carry=True).filter("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document with a smaller id holds too."""
    kept = whole_rows(line_dedup.line_dedup(docs, carry=True), docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Of several rows with that id one stays; a row without id stays only if no document of its group has one.
    """
    return jaccard_join.first_of_components(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; each row is judged by itself."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return whole_rows(found.filter("not contaminated"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token identifiers and, from these, its text again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_codec.round_trip(docs, path)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("BPE encoding and decoding", tokens)]

#: SQL has no zstandard and no BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
