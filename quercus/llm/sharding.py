"""Sharding by balanced label propagation: linked documents move together, sizes stay even.

Documents are linked when their texts are equal (or by any group column).  All
start on shards drawn from their id.  In every round each linked unit counts,
by joins and aggregates, how many bytes of it lie on each shard, and its
documents ask to move to the heaviest.  A shard admits only as much as its
quota leaves; when more ask, each is admitted with that probability, decided by
a hash.  A last pass levels the sizes: what lies beyond the mean of a shard,
unlinked and small documents first, fills what others lack.

A group that outgrows a fraction of a shard can't be kept whole; it is cut
beforehand into units by hash, so no key holds more than a bounded share of the
rows, and each unit travels on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SHARDS, ROUNDS, HEADROOM, UNITS_PER_SHARD = 24, 3, 0.25, 8


def _draw(*columns: str | Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _running(df: DataFrame, keys: list[str], order: list[Column], value: Column, within: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over earlier rows of the same ``keys``.

    Rows are ordered by the column ``within`` and then by ``order``; sums within
    one ``within`` value and over the short table of their totals are separate,
    so a key's rows are never in one task.
    """
    fine = [*keys, within]
    sums = df.groupBy(*fine).agg(F.sum(value).alias("_t"))
    sums = sums.withColumn("_b", F.sum("_t").over(Window.partitionBy(*keys).orderBy(within)) - F.col("_t")).drop("_t")
    own = df.withColumn("_o", F.sum(value).over(Window.partitionBy(*fine).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - value)
    return own.join(sums, fine).withColumn("before", F.col("_o") + F.col("_b")).drop("_o", "_b")


def shard(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS, headroom: float = HEADROOM, units_per_shard: int = UNITS_PER_SHARD, buckets: int = 512) -> DataFrame:
    """Puts the documents of ``docs`` (doc_id, text; other columns are ignored) into ``n_shards`` shards of near equal bytes.

    A document weighs the UTF-8 bytes of its text (null: none) plus 8.  Null
    texts are linked with each other, and so are empty ones.  Repeated rows are
    documents of their own.  An empty table gives an empty result.  Returns
    doc_id, size, text_crc32 (of a null text: 0), law, shard, slot, grown_shard.
    """
    raw = F.col("text").cast("string").cast("binary")
    nodes = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(F.col("text").isNull(), F.lit("")).otherwise(F.sha2(raw, 256)).alias("link"),
        )
    )
    groups = nodes.groupBy("link").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where("n > 1")
    total = nodes.agg(F.sum("size").alias("total")).first()["total"]
    mean = (total or 0) / n_shards
    # fewer than n_shards * units_per_shard groups can be larger than this, so they may be broadcast
    largest = max(1.0, mean / units_per_shard)
    cut = groups.where(F.col("bytes") > largest).select("link", F.ceil(F.col("bytes") / largest).alias("units"))
    nodes = nodes.join(F.broadcast(cut), "link", "left").withColumn("units", F.coalesce("units", F.lit(1)))
    nodes = nodes.select("doc_id", "size", "text_crc32", F.xxhash64("link", F.pmod(F.xxhash64("doc_id"), "units")).alias("unit"), F.floor(_draw("doc_id", "link", salt=1) * n_shards).cast("int").alias("shard"))
    linked = nodes.groupBy("unit").agg(F.count("*").alias("n")).select("unit", (F.col("n") > 1).alias("linked"))
    state = stored(nodes.join(linked, "unit"))
    for r in range(rounds):
        votes = state.where("linked").groupBy("unit", "shard").agg(F.sum("size").alias("w"))
        target = votes.groupBy("unit").agg(F.max_by("shard", F.struct("w", F.xxhash64("unit", "shard"))).alias("target"))
        asked = state.join(target, "unit", "left").withColumn("moves", F.coalesce(F.col("target") != F.col("shard"), F.lit(False)))
        # one row a shard: what it holds, and what asks to come
        held = asked.groupBy("shard").agg(F.sum("size").alias("load"))
        wants = asked.where("moves").groupBy(F.col("target").alias("shard")).agg(F.sum("size").alias("asking"))
        share = F.greatest(F.lit(0.0), F.lit(mean * (1 + headroom)) - F.coalesce("load", F.lit(0))) / F.col("asking")
        quota = wants.join(held, "shard", "left").select(F.col("shard").alias("target"), share.alias("share"))
        went = F.col("moves") & (_draw("doc_id", "unit", salt=100 + r) < F.col("share"))
        state = stored(asked.join(F.broadcast(quota), "target", "left").select("doc_id", "size", "text_crc32", "unit", "linked", F.when(went, F.col("target")).otherwise(F.col("shard")).alias("shard")))
    # levelling: linked documents and large ones have the first claim on their shard
    spread = F.format_string("%d-%05d-%05d", F.when(F.col("linked"), 0).otherwise(1), (F.lit(100) - F.floor(F.log2("size") * 2)).cast("int"), F.pmod(F.xxhash64("unit"), F.lit(buckets)).cast("int"))
    order = [F.col("unit"), F.col("doc_id"), F.col("text_crc32")]
    placed = stored(_running(state.withColumn("rank", spread), ["shard"], order, F.col("size"), "rank"))
    stays = F.col("before") + F.col("size") <= F.lit(mean)
    kept = placed.where(stays)
    room = placed.select("shard").distinct().join(kept.groupBy("shard").agg(F.sum("size").alias("load")), "shard", "left")
    every = state.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    room = every.join(room, "shard", "left").select("shard", F.greatest(F.lit(0.0), F.lit(mean) - F.coalesce("load", F.lit(0))).alias("room"))
    upto = F.sum("room").over(Window.orderBy("shard"))  # one row a shard
    room = room.select(F.col("shard").alias("to"), (upto - F.col("room")).alias("lo"), upto.alias("hi")).where("hi > lo")
    # what is over is laid end to end in the order of size, and cut where the rooms end
    over = placed.where(~stays).drop("before", "shard").withColumn("all", F.lit(0)).withColumn("rank", F.format_string("%05d-%05d", (F.lit(100) - F.floor(F.log2("size") * 2)).cast("int"), F.pmod(F.xxhash64("unit"), F.lit(buckets)).cast("int")))
    over = _running(over, ["all"], order, F.col("size"), "rank")
    middle = F.col("before") + F.col("size") / 2
    moved = over.join(F.broadcast(room), (middle >= F.col("lo")) & (middle < F.col("hi")), "left")
    moved = moved.select("doc_id", "size", "text_crc32", F.coalesce("to", F.lit(n_shards - 1)).alias("shard"))
    final = stored(kept.select("doc_id", "size", "text_crc32", "shard").union(moved).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))))
    slots = _running(final, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.lit(1).cast("long"), "bucket")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("before").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23, equal texts together where sizes allow."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
