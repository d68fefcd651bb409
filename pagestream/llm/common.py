"""Shared helpers: checkpoint tables, Arrow batch limits and connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the checkpoint folder that the caller has set. Where neither is, a temporary
    one serves on a single machine (tests), and a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        kept = context._jsc.sc().getCheckpointDir()
        if not kept.isDefined():
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
            kept = context._jsc.sc().getCheckpointDir()
        where = kept.get()
    return where


def cut(df: DataFrame, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later stages survive lost executors
    and never recompute what stands before the cut. by: a column of few values that get a folder each."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    to = df.write.option("compression", compression)
    if by:
        with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "8"):  # else rows are sorted by the column
            to.partitionBy(by).parquet(path)
    else:
        to.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete tables made by `cut`, or one folder of them, that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{t._cut_path}/{part}")
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release(spark: SparkSession, wait: float = 0.0) -> None:
    """Let Spark drop the shuffle files of phases whose results are already written. wait: seconds that the executors get
    for it before the next phase writes its own. Spark's listeners hold on to the last query they heard of, so a tiny one
    takes its place first."""
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(wait)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get at most this many documents at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for what is run inside; it is put back after."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int):
    """Python workers get at most this many rows at a time in what is run inside."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a column __row that no two rows share. doc_id serves if it is a key; else numbers are made
    and the numbered table is written, so that they hold for good. The flag tells whether doc_id serves."""
    n = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("m")).first()
    if n.n == n.m and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn("__row", F.col("doc_id").cast("long")), True
    return cut(docs.withColumn("__row", F.monotonically_increasing_id())), False


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of edges(a, b): one row (node, component) per node of an edge; component is
    the smallest node reachable. First every node joins its smallest neighbour, which contracts most edges;
    then smallest labels travel along the edges left and labels are followed to their own label, so rounds
    grow with the logarithm of the diameter. Every step is a join or a minimum that is combined before the
    shuffle; no group is gathered."""
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    start = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    to_a, to_b = start.select(F.col("node").alias("a"), F.col("label").alias("x")), start.select(F.col("node").alias("b"), F.col("label").alias("y"))
    left = cut(edges.join(to_a, "a").select("x", "b").distinct().join(to_b, "b").select("x", "y").where("x != y").distinct())
    joins = cut(left.unionByName(start.where("node != label").select(F.col("node").alias("x"), F.col("label").alias("y"))))
    pairs = cut(joins.unionByName(joins.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = cut(pairs.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("component")))
    while True:
        near = pairs.join(label, pairs.y == label.node).groupBy("x").agg(F.min("component").alias("near"))
        hop = label.join(near, label.node == near.x).select("node", F.least("component", "near").alias("hop"), F.col("component").alias("was"))
        old = label.select(F.col("node").alias("at"), F.col("component").alias("further"))
        new = cut(hop.join(old, hop.hop == old["at"], "left").select("node", F.least("hop", F.coalesce("further", "hop")).alias("component"), "was"))
        changed = not new.where("component != was").isEmpty()
        label = new.select("node", "component")
        if not changed:
            return label
