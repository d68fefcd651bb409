"""Tables of a folder, and stand-ins made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to all cores before work that takes long for each: files of few splits would keep it in few tasks.
    The count is given, as Spark would else merge parts of few bytes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(carrier, n, re, im, x): events of a user as the samples of a carrier."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("carrier"), F.col("event_id").alias("n"), F.cos("value").alias("re"), F.sin("value").alias("im"), F.col("value").alias("x"))


SAMPLES = "SELECT user_id AS carrier, event_id AS n, cos(value) AS re, sin(value) AS im, value AS x FROM events"
