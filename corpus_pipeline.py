"""A corpus from raw documents to packed sequences: quality rules, exact dedup, near dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import exact_dedup, near_copies, packing, quality
from inkveil.llm.shared import land


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule, with all their columns as they are.

    Null texts are empty and have too few words; repeated rows are judged alike, each for itself; an empty table gives none.
    """
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest, then the one with the smallest id.

    Null texts are empty; repeated rows leave one; a repeated or null id loses no other text.
    """
    return exact_dedup.drop_copies(docs, rank="length(coalesce(text, ''))")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 or more over five-word shingles make, the document with the smallest id.

    SimHash balls, bands of minima and rare shingles gather the candidates, shared shingles decide. Null texts are empty;
    repeated rows leave one; a repeated id loses no text of another group; a null id stays if its group has no other.
    """
    return near_copies.one_of_each_group(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of 4096 ids.

    Null and empty texts are their end id; repeated rows are placed each for itself; an empty table gives none.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

#: SQL expresses neither SimHash nor the tokenizer; see tests/llm/test_pipeline.py for the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
