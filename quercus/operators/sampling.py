"""Encodings and samples of rows and columns."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import ordinals


def sorted_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Adds the rank of a value among the distinct ones, -1 for null: a small table of values, joined back."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    return df.join(ordinals(values, column, code), column, "left").na.fill(-1, [code])


def first_seen_codes(df: DataFrame, column: str, key: str, code: str) -> DataFrame:
    """Adds the rank of a value by the first key that has it."""
    first = df.groupBy(column).agg(F.min(key).alias("_first"))
    return df.join(ordinals(first, "_first", code).drop("_first"), column)


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.7, seed: int = 0) -> DataFrame:
    """Adds ``train``: the ``share`` of each class with the lowest keyed hash.

    Ranks are counted within hash buckets first, so that a class is never in one task.
    """
    h = F.xxhash64(key, F.lit(seed))
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftright(h, 54))
    sizes = rows.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(label)
    sizes = sizes.withColumn("_before", F.sum("_n").over(by.orderBy("_b")) - F.col("_n")).withColumn("_all", F.sum("_n").over(by)).drop("_n")
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) + F.col("_before")
    return rows.join(sizes, [label, "_b"]).withColumn("train", rank <= F.round(F.col("_all") * share)).drop("_h", "_b", "_before", "_all")


def without_replacement(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Exactly the rounded share of rows: those of lowest keyed hash."""
    return stratified_split(df.withColumn("_one", F.lit(1)), "_one", key, share, seed).where("train").drop("train", "_one")


def taken_poisson(key: str, share: float, seed: int = 0) -> Column:
    """Whether a row is in a sample that takes each row on its own with probability ``share``, drawn from its key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def poisson(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Each row on its own with probability ``share``, drawn from its key."""
    return df.where(taken_poisson(key, share, seed))


def chunk(key: str, chunks: int) -> Column:
    """The number of a row's chunk: the first 28 bits of its key's MD5 digest, modulo ``chunks``, so that any engine finds the same."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long") % chunks


def taken_disjoint(key: str, share: float, turn: int) -> Column:
    """Whether a row is in chunk ``turn`` of a partition into chunks of about ``share``."""
    chunks = max(1, math.ceil(1 / share))
    return chunk(key, chunks) == turn % chunks


def disjoint(df: DataFrame, key: str, share: float, turn: int) -> DataFrame:
    """Chunk ``turn`` of a partition of the rows into chunks of about ``share``."""
    return df.where(taken_disjoint(key, share, turn))


def columns(n: int, fraction: float, seed: int) -> list[int]:
    """``ceil(fraction * n)`` columns in ascending order."""
    return sorted(random.Random(seed).sample(range(n), math.ceil(fraction * n)))


def cyclical(n: int, k: int, turn: int) -> list[int]:
    """The features of a turn when ``k`` at a time take turns."""
    if k == 1:
        return [turn % n]
    return list(next(itertools.islice(itertools.combinations(range(n), k), turn % math.comb(n, k), None)))


def random_k(n: int, k: int, seed: int) -> list[int]:
    return sorted(random.Random(seed).sample(range(n), k))
