"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteprofile.llm import jaccard, line_dedup, mixing, packing, quality
from siteprofile.llm.common import materialize
from siteprofile.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, with their columns. Null or empty texts fail and go; an empty table gives none."""
    return quality.filter_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that stand in an earlier one; those that lose their last word go. Null texts stay; long texts and lines are read whole; an empty table gives none; columns of any name are kept."""
    return line_dedup.rewrite(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest doc_id; rows with null doc_id stay. Null and empty texts link with nothing; long texts are read whole; an empty table gives none; columns of any name are kept."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: rows as often as they are taken, with their columns. Null source: a source of its own. Null and empty texts have size 0; long texts count whole; an empty table gives none; columns of any name are kept."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a null or empty text is its end token alone. Long texts go over as many sequences as they need; an empty table gives none."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither SimHash groups nor the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on all that the one before kept. Between stages the table is written to the shared folder, so lineage ends there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
