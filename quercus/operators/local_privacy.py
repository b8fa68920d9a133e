"""Local differential privacy: each row is perturbed by itself, aggregates are corrected.

Draws come from hashes of the row's key, so that a task run again draws the same.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import counted_quantiles
from .ordering import running


def draw(key: Column | str, seed: int) -> Column:
    """Uniform on (0, 1), of a key."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def hash_range(epsilon: float, optimal: bool = True) -> int:
    return round(math.exp(epsilon)) + 1 if optimal else 2


def hash_reports(df: DataFrame, key: str, item: str, epsilon: float, seeds: int = 500, optimal: bool = True, seed: int = 0) -> DataFrame:
    """Local hashing: each row reports a hash family member (s) and a perturbed hash (y) of its item."""
    g = hash_range(epsilon, optimal)
    p = math.exp(epsilon) / (math.exp(epsilon) + g - 1)
    s = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(seeds)).cast("int")
    true = F.pmod(F.xxhash64(F.lit(11), F.col("s"), F.col(item).cast("string")), F.lit(g)).cast("int")
    other = F.pmod(F.xxhash64(key, F.lit(seed + 3)), F.lit(g - 1)).cast("int")
    rows = df.withColumn("s", s).withColumn("_t", true)
    return rows.select("s", F.when(draw(key, seed + 2) < p, F.col("_t")).otherwise(F.when(other >= F.col("_t"), other + 1).otherwise(other)).alias("y"))


def hash_estimates(reports: DataFrame, domain: DataFrame, item: str, epsilon: float, optimal: bool = True, seeds: int = 500) -> DataFrame:
    """Frequencies of the items of ``domain``: reports aggregate to (s, y), a table whose size the parameters set, and every item adds up its cells in a row of its own.

    ``seeds`` is the number of hash family members that ``hash_reports`` chose from.
    """
    g = hash_range(epsilon, optimal)
    p = math.exp(epsilon) / (math.exp(epsilon) + g - 1)
    held = [0] * (seeds * g)
    for r in reports.groupBy("s", "y").agg(F.count("*").alias("n")).collect():  # seeds times g cells
        held[r["s"] * g + r["y"]] = r["n"]
    n = sum(held)
    cells = F.broadcast(domain.sparkSession.createDataFrame([(held,)], "_cells array<long>"))  # one row
    place = lambda s: s * g + F.pmod(F.xxhash64(F.lit(11), s, F.col(item).cast("string")), F.lit(g)).cast("int")
    support = F.aggregate(F.sequence(F.lit(0), F.lit(seeds - 1)), F.lit(0).cast("long"), lambda total, s: total + F.get("_cells", place(s)))
    return domain.select(item).distinct().crossJoin(cells).select(item, (g / (p * g - 1) * support - n / (p * g - 1)).alias("estimate"))


def bounded_report(x: Column, key: str, epsilon: float, kind: str = "hybrid", seed: int = 0) -> Column:
    """An unbiased report of a value in [-1, 1]: stochastic rounding, the piecewise mechanism, or a mix of both."""
    e = math.exp(epsilon)
    u, v, w = draw(key, seed), draw(key, seed + 1), draw(key, seed + 2)
    rounding = F.when(u < (x * (e - 1) + e + 1) / (2 * (e + 1)), F.lit((e + 1) / (e - 1))).otherwise(F.lit(-(e + 1) / (e - 1)))
    half = math.exp(epsilon / 2)
    c = (half + 1) / (half - 1)
    lo = (c + 1) / 2 * x - (c - 1) / 2
    hi = lo + c - 1
    left, right = lo + c, c - hi
    outside = F.when(v * (left + right) < left, -c + v * (left + right)).otherwise(hi + v * (left + right) - left)
    piecewise = F.when(u < half / (half + 1), lo + v * (hi - lo)).otherwise(outside)
    if kind == "rounding" or kind == "hybrid" and epsilon <= 0.61:
        return rounding
    return piecewise if kind == "piecewise" else F.when(w < 1 - math.exp(-epsilon / 2), piecewise).otherwise(rounding)


def square_wave_width(epsilon: float) -> float:
    e = math.exp(epsilon)
    return (epsilon * e - e + 1) / (2 * e * (e - 1 - epsilon))


def square_wave_report(x: Column, key: str, epsilon: float, seed: int = 0) -> Column:
    """A report of a value in [0, 1]: near it with high density, anywhere else with low density."""
    b, e = square_wave_width(epsilon), math.exp(epsilon)
    q = 1 / (2 * b * e + 1)
    u, v = draw(key, seed), draw(key, seed + 1)
    near = x - b + v * 2 * b
    away = F.when(v < x, v - b).otherwise(v + b)
    return F.when(u < 2 * b * e * q, near).otherwise(away)


def square_wave_density(reports: DataFrame, column: str, epsilon: float, bins: int = 256, rounds: int = 200, smooth: bool = True) -> list[float]:
    """Shares of ``bins`` cells of [0, 1] by expectation-maximisation over a histogram of the reports."""
    b, e = square_wave_width(epsilon), math.exp(epsilon)
    q = 1 / (2 * b * e + 1)
    cell = F.least(F.greatest(F.floor((F.col(column) + b) / (1 + 2 * b) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    got = dict(reports.groupBy(cell.alias("c")).count().collect())
    counts = np.array([got.get(i, 0) for i in range(bins)], dtype=np.float64)
    at = (np.arange(bins) + 0.5) / bins
    seen = (np.arange(bins) + 0.5) / bins * (1 + 2 * b) - b
    m = np.where(np.abs(seen[:, None] - at[None, :]) <= b, q * e, q) * (1 + 2 * b) / bins
    theta = np.full(bins, 1 / bins)
    for _ in range(rounds):
        theta = theta * (m.T @ (counts / np.maximum(m @ theta, 1e-300)))
        theta /= theta.sum()
        if smooth:
            theta = np.convolve(np.pad(theta, 1, mode="edge"), [0.25, 0.5, 0.25], "valid")
            theta /= theta.sum()
    return theta.tolist()


def hashed_quantiles(df: DataFrame, column: str, key: str, q: int, lo: float, hi: float, epsilon: float, seed: int = 0, bins: int = 1024, seeds: int = 500) -> list[float]:
    """Quantiles (k+1)/q from local hashing reports of each row's cell of ``bins`` equal ones."""
    x = F.col(column).cast("double")
    width = (hi - lo) / bins or 1.0
    cell = F.least(F.floor((F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - lo) / width), F.lit(bins - 1)).cast("int")
    reports = hash_reports(df.where(x.isNotNull() & ~F.isnan(x)).select(key, cell.alias("cell")), key, "cell", epsilon, seeds, seed=seed)
    domain = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("cell"))
    got = {r["cell"]: r["estimate"] for r in hash_estimates(reports, domain, "cell", epsilon, seeds=seeds).collect()}  # a row a cell
    return sorted(set(counted_quantiles([max(0.0, got.get(i, 0.0)) for i in range(bins)], [lo + i * width for i in range(bins + 1)], q)))


def wave_quantiles(df: DataFrame, column: str, key: str, q: int, lo: float, hi: float, epsilon: float, seed: int = 0, bins: int = 1024) -> list[float]:
    """Quantiles (k+1)/q from square-wave reports of each row's value."""
    x = F.col(column).cast("double")
    unit = F.least(F.greatest((x - lo) / ((hi - lo) or 1.0), F.lit(0.0)), F.lit(1.0))
    reports = df.where(x.isNotNull() & ~F.isnan(x)).select(square_wave_report(unit, key, epsilon, seed).alias("r"))
    shares = square_wave_density(reports, "r", epsilon, bins, smooth=False)
    return sorted(set(counted_quantiles(shares, [lo + (hi - lo) * i / bins for i in range(bins + 1)], q)))


def _sums_from_above(df: DataFrame, column: str) -> DataFrame:
    """Distinct values x with how many rows have them or larger ones (upto_n), and the sum of these (upto_t), by range partitions."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    return running(counts.withColumn("t", F.col("n") * F.col("x")), "x", ["n", "t"], descending=True)


def to_simplex(df: DataFrame, column: str, out: str, total: float = 1.0) -> DataFrame:
    """The nearest point of the simplex, for a table of one row an item: running sums from the largest item down give the common shift."""
    shift = (F.col("upto_t") - total) / F.col("upto_n")
    cut = _sums_from_above(df, column).select("x", shift.alias("shift")).where("x > shift").agg(F.min_by("shift", "x").alias("shift"))
    return df.crossJoin(F.broadcast(cut)).withColumn(out, F.greatest(F.col(column) - F.col("shift"), F.lit(0.0))).drop("shift")


def add_evenly(df: DataFrame, column: str, out: str, total: float) -> DataFrame:
    """The same amount added to every item, so that they sum to ``total``."""
    sums = df.agg(((total - F.sum(column)) / F.count("*")).alias("_d"))
    return df.crossJoin(F.broadcast(sums)).withColumn(out, F.col(column) + F.col("_d")).drop("_d")


def cut_threshold(df: DataFrame, column: str, out: str, total: float) -> DataFrame:
    """The largest items as long as their running sum stays within ``total``; the others are 0.  Equal items stand or fall together."""
    least = _sums_from_above(df, column).where((F.col("x") > 0) & (F.col("upto_t") <= total)).agg(F.min("x").alias("_least"))
    return df.crossJoin(F.broadcast(least)).withColumn(out, F.when(F.col(column) >= F.col("_least"), F.col(column)).otherwise(F.lit(0.0))).drop("_least")
