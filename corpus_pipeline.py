"""Cleaning and packing of a corpus: quality rules, line dedup, near-duplicate join, repeated strings, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagestream.llm import jaccard_join, line_dedup, packing, quality, suffix_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the divergence rules keep."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one, exactly or but for one word."""
    return line_dedup.clean(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at 0.8."""
    return jaccard_join.keep_one_of_each(docs, size=5, percent=80)


def dedup_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 240 bytes (some 50 words of short letters) that occur elsewhere too."""
    return suffix_dedup.clean(docs, width=240)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("suffix-array dedup", dedup_strings),
    ("packing", pack_sequences),
]

#: Line and string removal, components and packing are beyond SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written as Parquet in the shared folder and read again."""
    from pagestream.llm.common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
