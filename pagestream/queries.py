"""Registry of the queries and of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.plans import codes, extras, messages, places, signal, symbols, texts, walks


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, readable ones and their mean score by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "text")
    scored = docs.select("source", T.english_score(F.col("text")).alias("score"), T.is_clean_alpha(F.col("text")).alias("clean"))
    return scored.groupBy("source").agg(F.count("*").alias("n"), F.count_if("clean").alias("n_clean"), F.round(F.avg("score"), 6).alias("score")).orderBy("source")


def _all() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for module in (texts, codes, messages, signal, places, walks, symbols, extras):
        out |= module.QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for name, q in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for name, q in _all().items() if q[1]}
