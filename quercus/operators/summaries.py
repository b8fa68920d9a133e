"""Quantile summaries that are stored, merged later and asked for thresholds; of dense columns and of sparse rows.

A summary is a row: what it is of, a mergeable sketch as a binary column, counts
and the range.  Summaries of days or partitions are appended to a table and
merged when thresholds are wanted; the same rows come from a streaming aggregate.

Sparse rows are maps from feature number to value, what a map lacks being 0.
Zeros are never rows: what is left of the number of rows enters a feature's
sketch as one weight, by merging sketches of one, two, four and so on zeros.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binning import EDGE, searched

#: Rank error of a summary where none is asked for; with this share of certainty a rank is within it.
ERROR, CERTAINTY = 0.001, 0.99
_FIELDS = ["sketch", "n", "missing", "lo", "hi"]


def size_for(error: float) -> int:
    """The sketch's parameter whose rank error is ``error`` (its published bound, 2.296 / k^0.9021, between 8 and 65,535)."""
    return max(8, min(65_535, math.ceil((2.296 / error) ** (1 / 0.9021))))


def _value(f: Column | str) -> Column:
    x = (F.col(f) if isinstance(f, str) else f).cast("double")
    return F.when(~F.isnan(x), x)


def summarised(df: DataFrame, features: Sequence[str], keys: Sequence[Column | str] = (), error: float = ERROR) -> DataFrame:
    """Summaries of ``features``, one row for each key and feature: the keys, feature, sketch, n, missing, lo, hi.

    Nulls and NaN are counted as missing.  One aggregate, combined before the
    shuffle; ``df`` may be a stream with a window among the keys.
    """
    k = size_for(error)
    parts = []
    for i, f in enumerate(features):
        x = _value(f)
        parts += [F.kll_sketch_agg_double(x, F.lit(k)).alias(f"_sketch{i}"), F.count(x).alias(f"_n{i}"), (F.count("*") - F.count(x)).alias(f"_missing{i}"), F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    out = df.groupBy(*keys).agg(*parts)
    names = [c for c in out.columns if not c.startswith(tuple(f"_{x}" for x in _FIELDS))]
    each = F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"_{x}{i}").alias(x) for x in _FIELDS]) for i, f in enumerate(features)])
    return out.select(*names, F.explode(each).alias("s")).select(*names, "s.*")


def merged(summaries: DataFrame, keys: Sequence[Column | str] = ()) -> DataFrame:
    """Summaries of the same feature and keys made one; other columns go."""
    return summaries.groupBy(*keys, "feature").agg(F.kll_merge_agg_double("sketch").alias("sketch"), *[F.sum(c).alias(c) for c in ("n", "missing")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def append(summaries: DataFrame, path: str) -> None:
    """Adds summaries to the table at ``path``."""
    summaries.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def quantile(rate: float | Sequence[float]) -> Column:
    """The value at a share of the rows (or the values at several), of the summary in a row; null without values."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(rate)))


def rank(points: float | Sequence[float]) -> Column:
    """The share of values up to and with a point (or several), of the summary in a row."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_rank_double("sketch", F.lit(points)))


def thresholds(summaries: DataFrame, q: int = 32, keys: Sequence[str] = ()) -> DataFrame:
    """Split points at (i+1)/q, without repeats and ascending: the keys, feature, i, v."""
    values = F.array_sort(F.array_distinct(quantile([(i + 1) / q for i in range(q)])))
    return summaries.select(*keys, "feature", F.posexplode(values).alias("i", "v"))


def split_points(df: DataFrame, features: Sequence[str], q: int = 32, error: float = ERROR) -> dict[str, list[float]]:
    """Split points of every feature of a table, from its summaries."""
    out: dict[str, list[float]] = {f: [] for f in features}
    for r in thresholds(summarised(df, features, error=error), q).orderBy("feature", "i").collect():  # ``q`` rows a feature
        out[r["feature"]].append(r["v"])
    return out


# --- sparse rows -----------------------------------------------------------------------------------------------------
def _entries(df: DataFrame, column: str, *others: str) -> DataFrame:
    """What is stored in the maps: feature, x (null: missing) and other columns; stored zeros are zeros like the rest."""
    return df.select(*others, F.explode(column).alias("feature", "_x")).withColumn("x", _value("_x")).where(F.col("x").isNull() | (F.col("x") != 0)).drop("_x")


def _with_zeros(summaries: DataFrame, zeros: str, k: int) -> DataFrame:
    """Sketches with as many zeros more as the column ``zeros`` says: its bits choose among sketches that double."""
    one = summaries.sparkSession.range(1).agg(F.kll_sketch_agg_double(F.lit(0.0), F.lit(k)).alias("_one"))
    rows = summaries.crossJoin(F.broadcast(one))  # one row
    bits = F.transform(F.sequence(F.lit(0), F.length(F.bin(zeros)) - 1), lambda b: F.substring(F.reverse(F.bin(zeros)), b + 1, F.lit(1)) == "1")

    def step(s: Column, bit: Column) -> Column:
        joined = F.when(s["sum"].isNull(), s["power"]).otherwise(F.kll_sketch_merge_double(s["sum"], s["power"]))
        return F.struct(F.when(bit, joined).otherwise(s["sum"]).alias("sum"), F.kll_sketch_merge_double(s["power"], s["power"]).alias("power"))

    start = F.struct(F.col("sketch").alias("sum"), F.col("_one").alias("power"))
    return rows.withColumn("sketch", F.when(F.col(zeros) > 0, F.aggregate(bits, start, step)["sum"]).otherwise(F.col("sketch"))).drop("_one")


def sparse_summarised(df: DataFrame, column: str, keys: Sequence[str] = (), error: float = ERROR) -> DataFrame:
    """Summaries of the features of sparse rows, of the form that ``summarised`` gives, and ``stored``, how many values are not 0.

    Features that no map of a key stores have no row there; all their values are 0.  Null maps are empty.
    """
    rows, k = df.select(*keys, F.col(column).alias("_map")), size_for(error)
    each = _entries(rows, "_map", *keys).groupBy(*keys, "feature")
    of = each.agg(F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch"), F.count("x").alias("stored"), (F.count("*") - F.count("x")).alias("missing"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("_all"))
    joined = of.join(total, list(keys)) if keys else of.crossJoin(F.broadcast(total))  # one row
    joined = joined.withColumn("n", F.col("_all") - F.col("missing")).withColumn("_zeros", F.col("n") - F.col("stored"))
    some = F.col("_zeros") > 0
    joined = joined.withColumn("lo", F.when(some, F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))).withColumn("hi", F.when(some, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")))
    return _with_zeros(joined, "_zeros", k).select(*keys, "feature", "sketch", "n", "missing", "lo", "hi", "stored")


def sparse_histogram(df: DataFrame, column: str, cands: dict[int, Sequence[float]], g: Column, h: Column, node: Column | None = None) -> DataFrame:
    """``binning.histogram`` of sparse rows: node, feature (its number), bin, g, h, n; missing values are in no bin.

    Only what is stored is aggregated by bin; a node's totals, less what its
    features store, go to the bins that hold 0, as one weight each.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(int(f), [float(c + EDGE) for c in v], sum(c + EDGE <= 0 for c in v)) for f, v in cands.items()], "feature int, edges array<double>, zero int")
    rows = df.select((F.lit(1) if node is None else node).alias("node"), g.alias("g"), h.alias("h"), F.col(column).alias("_map")).where("node is not null")
    longest = max((len(v) for v in cands.values()), default=0)
    stored = _entries(rows, "_map", "node", "g", "h").join(table, "feature")
    stored = stored.withColumn("bin", searched(F.col("x"), F.col("edges"), longest))  # null where the value is missing
    stored = stored.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    totals = rows.groupBy("node").agg(F.sum("g").alias("tg"), F.sum("h").alias("th"), F.count("*").alias("tn"))
    used = stored.groupBy("node", "feature").agg(F.sum("g").alias("ug"), F.sum("h").alias("uh"), F.sum("n").alias("un"))
    spots = totals.crossJoin(F.broadcast(table.select("feature", F.col("zero").alias("bin"))))  # nodes times features
    less = lambda a, b: F.col(a) - F.coalesce(F.col(b), F.lit(0))
    zeros = spots.join(used, ["node", "feature"], "left").select("node", "feature", "bin", less("tg", "ug").alias("g"), less("th", "uh").alias("h"), less("tn", "un").alias("n")).where("n > 0")
    both = stored.where("bin is not null").unionByName(zeros)
    return both.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def zero_bins(points: dict[int, Sequence[float]]) -> dict[int, int]:
    """The right-closed bin that holds 0, by feature."""
    return {f: sum(p < 0 for p in v[:-1]) for f, v in points.items()}


def sparse_converted(df: DataFrame, column: str, points: dict[int, Sequence[float]], woe: dict[int, Sequence[float | None]] | None = None) -> DataFrame:
    """``df`` with the stored values of the features of ``points`` replaced by their right-closed bin, or its weight.

    Other features stay, missing values become null; an implied 0 is in the bin that ``zero_bins`` gives.
    """
    if not points:
        return df
    inner = F.create_map(*[p for f, v in points.items() for p in (F.lit(int(f)), F.lit([float(x) for x in v[:-1]]) if len(v) > 1 else F.array().cast("array<double>"))])
    longest = max(len(v) for v in points.values())

    def new(f: Column, v: Column) -> Column:
        x = F.when(~F.isnan(v.cast("double")), v.cast("double"))
        edges = F.try_element_at(inner, f.cast("int"))
        bin_ = searched(x, edges, longest, strict=True)
        if woe is not None:
            weights = F.create_map(*[p for k, w in woe.items() for p in (F.lit(int(k)), F.array(*[F.lit(y).cast("double") for y in w]))])
            bin_ = F.get(F.try_element_at(weights, f.cast("int")), bin_)
        return F.when(edges.isNull(), v.cast("double")).otherwise(bin_.cast("double"))

    return df.withColumn(column, F.transform_values(column, new))
