"""What the training-data operators share: stored intermediate tables, components, column names."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows that goes to a Python worker: without a bound 10,000 texts of any length are one, which the JVM and the worker both hold.
BATCH_BYTES = 1 << 22


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches for Python end at ``BATCH_BYTES``, or where the session itself says; rows are neither left out nor cut."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests) a fresh local folder is set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named := "file://" + tempfile.mkdtemp(prefix="spark-"))
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir() or named


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from a Parquet table in the shared folder.

    It cuts the lineage, survives lost executors, and keeps later scans column-pruned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quercus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of ``links`` (src, dst: long), by alternating large-star and small-star steps.

    Returns node, component (its smallest node), for every node of a link.  Each
    step is one aggregation by node and one join; a node's neighbours are never
    gathered in one place: a star step only needs their minimum, which the
    partial aggregation finds before the shuffle.  The loop ends when a round
    changes nothing; a graph that is not settled after ``rounds`` rounds is an error.
    """
    edges = stored(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct())
    before = None
    for _ in range(rounds):
        # large star: neighbours above a node go to the smallest node around it
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = edges.select(F.col("v").alias("node"), F.col("u").alias("far"))
        large = large.join(least.withColumnRenamed("u", "node"), "node").select(F.col("far").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components: not settled after {rounds} rounds")


def linked_parts(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Connected parts of the links between two blocks (or within one): the least position in each row's part; columns count on after the rows."""
    n, m = near.shape
    left, right = np.arange(n), np.arange(m) if same else n + np.arange(m)
    while True:
        far = n + m
        new = np.minimum(left, np.where(near, right[None, :], far).min(axis=1, initial=far))
        other = new if same else np.minimum(right, np.where(near, new[:, None], far).min(axis=0, initial=far))
        if (new == left).all() and (other == right).all():
            return new, other
        left, right = new, other
