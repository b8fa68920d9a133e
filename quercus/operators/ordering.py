"""Running sums and numbers over a whole ordered table, without bringing it into one task.

Rows are range-partitioned by their order once and stored; sums within a
partition and over the short table of partitions' totals are separate.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    On one machine (tests) a folder of its own serves; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


_OPEN = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within the block are deleted when it ends, also by an error: for work whose result lives on the driver."""
    paths: list[str] = []
    before, _OPEN.paths = getattr(_OPEN, "paths", None), paths
    try:
        yield
    finally:
        _OPEN.paths = before
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table's folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage, safe from lost executors."""
    path = f"{folder(df.sparkSession)}/quercus-{uuid.uuid4().hex}"
    if getattr(_OPEN, "paths", None) is not None:
        _OPEN.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``_p``, the number of its range partition; rows of equal order share one."""
    return stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def running(df: DataFrame, order: str, values: Sequence[str], keys: Sequence[str] = (), descending: bool = False, lead: bool = False) -> DataFrame:
    """Adds ``upto_<value>``: the sum of a value over the rows of the same ``keys`` up to and with this one, in ``order`` (no two rows of a key alike in it).

    With ``lead`` also ``next``, the order of the row behind it.
    """
    by = F.desc(order) if descending else F.asc(order)
    rows = ranged(df, by)
    ends = [(F.max if descending else F.min)(order).alias("_first")]
    parts = rows.groupBy(*keys, "_p").agg(*[F.sum(v).alias(f"_s_{v}") for v in values], *ends)
    w = Window.partitionBy(*keys).orderBy("_p")  # a row for each partition of a key
    parts = parts.select(*keys, "_p", *[(F.sum(f"_s_{v}").over(w) - F.col(f"_s_{v}")).alias(f"_b_{v}") for v in values], F.lead("_first").over(w).alias("_behind"))
    own = Window.partitionBy(*keys, "_p").orderBy(by)
    out = rows.withColumns({f"upto_{v}": F.sum(v).over(own) for v in values} | ({"next": F.lead(order).over(own)} if lead else {}))
    out = out.join(parts, [*keys, "_p"]).withColumns({f"upto_{v}": F.col(f"upto_{v}") + F.col(f"_b_{v}") for v in values})
    if lead:
        out = out.withColumn("next", F.coalesce("next", "_behind"))
    return out.drop("_p", "_behind", *[f"_b_{v}" for v in values])


def at_ranks(counts: DataFrame, spots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The values at ranks: ``counts`` has x and n (how often; a row for each value of a key), ``spots`` a few rows of ``at`` (rank from 0), ``keys`` and what else is to be kept."""
    upto = running(counts, "x", ["n"], keys)
    hit = (F.col("at") < F.col("upto_n")) & (F.col("at") >= F.col("upto_n") - F.col("n"))
    spots = F.broadcast(spots.select(*[F.col(c).alias(f"_k_{c}" if c in keys else c) for c in spots.columns]))
    for k in keys:
        hit = hit & (F.col(k) == F.col(f"_k_{k}"))
    return upto.join(spots, hit).drop("upto_n", "n", *[f"_k_{k}" for k in keys])


def ordinals(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the number (from 0) of each row in ``order``."""
    return running(df.withColumn("_one", F.lit(1)), order, ["_one"]).withColumn(name, (F.col("upto__one") - 1).cast("int")).drop("_one", "upto__one")
