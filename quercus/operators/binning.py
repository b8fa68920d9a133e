"""Binning, gradient histograms, split scores; supervised bins with weight of evidence."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.gains import gain

#: A value this close below a threshold's successor still belongs to the threshold's bin.
EDGE = 1e-11


def searched(x: Column, edges: Column, longest: int, strict: bool = False) -> Column:
    """How many of the ascending ``edges`` (an array of up to ``longest``) are at most ``x``, or with ``strict`` below it, by binary search; none for null and NaN."""
    steps = max(1, longest).bit_length()
    jumps = F.lit([1 << (steps - 1 - i) for i in range(steps)])

    def step(at: Column, jump: Column) -> Column:
        edge = F.get(edges, at + jump - 1)  # null beyond the end, where nothing lies below
        return F.when((edge < x) if strict else (edge <= x), at + jump).otherwise(at)

    return F.when(x.isNotNull() & ~F.isnan(x), F.aggregate(jumps, F.lit(0), step))


def _even(cands: Sequence[float]) -> float:
    """The distance between thresholds that are evenly spaced but for rounding, else 0."""
    if len(cands) < 2 or not all(map(math.isfinite, cands)):
        return 0.0
    step = (cands[-1] - cands[0]) / (len(cands) - 1)
    # a rounded quotient must be at most one place off, so rounding must stay far below a step
    clear = step > 1e3 * EDGE and step > 1e-9 * max(abs(cands[0]), abs(cands[-1]))
    return step if clear and all(abs(c - cands[0] - i * step) < step / 8 for i, c in enumerate(cands)) else 0.0


def bin_of(x: Column, cands: Sequence[float]) -> Column:
    """How many thresholds (ascending) lie below ``x`` (left-closed at ``EDGE`` above them); NaN and null have no bin.

    Of evenly spaced thresholds a division tells the bin but for one place,
    which a look at the thresholds around it settles; this stays in generated
    code.  Others are searched in a constant array: comparisons written out, as
    sums or as a tree, make code too long to be compiled, which costs more.
    """
    edges = [float(c + EDGE) for c in cands]
    if step := _even(cands):
        last = len(edges)
        near = F.floor((F.least(F.greatest(x, F.lit(edges[0])), F.lit(edges[-1])) - edges[0]) / step).cast("int")
        held = F.lit([-math.inf, *edges, math.nan, math.nan])  # place i + 1 has edge i; nothing is as large as NaN
        under = F.get(held, near + 2) <= x  # one more lies below
        over = F.get(held, near + 1) > x  # the last counted doesn't
        found = F.least(near + 1 + under.cast("int") - over.cast("int"), F.lit(last))
        return F.when(x.isNotNull() & ~F.isnan(x), found)
    return searched(x, F.lit(edges) if edges else F.array().cast("array<double>"), len(edges))


def bisect_left(x: Column, points: Sequence[float]) -> Column:
    """Right-closed bin: the number of split points, but the last, below ``x``."""
    inner = points[:-1]
    return sum((F.when(F.lit(float(p)) < x, 1).otherwise(0) for p in inner), F.lit(0))


def histogram(rows: DataFrame, cands: dict[str, Sequence[float]], g: Column, h: Column, node: Column | None = None, bins: Sequence[Column] | None = None, numbers: Sequence[int] | None = None) -> DataFrame:
    """Sums of gradients and hessians by (node, feature, bin): one pass, combined before the shuffle.

    ``rows`` needs the feature columns only; features are numbered in the order
    of ``cands``, or by ``numbers``.  Rows without a value of a feature are left out of its bins.
    ``bins`` are columns that hold them already.
    """
    found = [bin_of(F.col(f).cast("double"), c) for f, c in cands.items()] if bins is None else bins
    found = [b.cast("int").alias(f"_{j}") for j, b in enumerate(found)]
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_{j}").alias("bin")) for j, n in enumerate(numbers or range(len(found)))])
    flat = rows.select((F.lit(1) if node is None else node).alias("node"), g.alias("g"), h.alias("h"), *found).select("node", "g", "h", F.explode(each).alias("b"))
    flat = flat.select("node", "b.feature", "b.bin", "g", "h").where("bin is not null")
    return flat.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def dense(hist: DataFrame, sizes: Sequence[int], nodes: DataFrame | None = None) -> DataFrame:
    """The histogram with its empty bins, which noise must reach too: as many rows as nodes, features and bins make.

    ``nodes`` are the nodes, or pairs of a node and a feature.
    """
    spark = hist.sparkSession
    grid = spark.createDataFrame([(j, n) for j, n in enumerate(sizes)], "feature int, size int").select("feature", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("bin"))
    nodes = hist.select("node").distinct() if nodes is None else nodes
    full = nodes.join(F.broadcast(grid), "feature") if "feature" in nodes.columns else nodes.select("node").join(F.broadcast(grid))
    return full.join(hist, ["node", "feature", "bin"], "left").na.fill(0, ["g", "h", "n"])


def noisy(hist: DataFrame, sigma_g: float | Column, sigma_h: float | Column, seed: int | Column, node: Column | str = "node") -> DataFrame:
    """Gaussian noise on every cell, drawn from the cell's own key, so that a task run again draws the same.

    Deviations, seed and the node's part of the key may be columns, where cells of many trees lie together.
    """

    def normal(salt: int) -> Column:
        u = lambda k: (F.pmod(F.xxhash64(node, "feature", "bin", F.lit(seed), F.lit(salt + k)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
        return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1))

    return hist.withColumn("g", F.col("g") + sigma_g * normal(0)).withColumn("h", F.col("h") + sigma_h * normal(2))


#: How a node's totals are estimated; None: both children from the feature's own bins, the node from its parent's split.
ESTIMATORS = (None, "one-sided", "two_sided", "two_sided_averaging")


def scores(hist: DataFrame, sizes: Sequence[int], constraints: DataFrame | None = None, estimator: str | None = None, lam: float = 1.0, alpha: float = 0.0, delta: float = 2.0, totals: DataFrame | None = None, left_noise: tuple | None = None, width: int | None = None) -> DataFrame:
    """The score of every candidate of every feature and node: node, feature, cand, gl, hl, gr, hr, score, and the node's totals gn, hn.

    ``constraints`` (node, feature, lo, hi) narrows the bins of a node's feature.
    ``totals`` (node, gn, hn) are what the nodes' parents gave them; without
    them, and for two_sided_averaging, they are the mean over features of the
    histogram's totals.  With one-sided the right child is the rest of the
    node's totals, with two_sided the node's gain comes from the feature's bins
    but the last allowed one.  ``left_noise`` (what ``noisy`` takes) is drawn
    for every left child by itself, as where candidates are asked one by one.
    ``width`` is the number of features a node has, where it isn't that of ``sizes``.
    """
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator}")
    node = Window.partitionBy("node")
    if totals is None or estimator == "two_sided_averaging":
        hist = hist.withColumns({"gn": F.sum("g").over(node) / (width or len(sizes)), "hn": F.sum("h").over(node) / (width or len(sizes))})
    else:
        hist = hist.join(F.broadcast(totals), "node")
    if constraints is not None:
        hist = hist.join(F.broadcast(constraints), ["node", "feature"]).where("bin between lo and hi")
    by = Window.partitionBy("node", "feature")
    upto = by.orderBy("bin")
    own = hist.withColumns({"gl": F.sum("g").over(upto), "hl": F.sum("h").over(upto), "gt": F.sum("g").over(by), "ht": F.sum("h").over(by)})
    g_node, h_node = F.col("gn"), F.col("hn")
    if estimator == "two_sided":
        inner = F.col("bin") < F.col("hi") if constraints is not None else F.lit(True)
        own = own.withColumns({"gm": F.sum(F.when(inner, F.col("g")).otherwise(0)).over(by), "hm": F.sum(F.when(inner, F.col("h")).otherwise(0)).over(by)})
        g_node, h_node = F.col("gm"), F.col("hm")
    size = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("feature") + 1)
    own = own.where(F.col("bin") < size)
    if left_noise:
        own = noisy(own.drop("g", "h").withColumnRenamed("gl", "g").withColumnRenamed("hl", "h"), *left_noise).withColumnRenamed("g", "gl").withColumnRenamed("h", "hl")
    whole = ("gn", "hn") if estimator == "one-sided" else ("gt", "ht")
    own = own.withColumns({"gr": F.col(whole[0]) - F.col("gl"), "hr": F.col(whole[1]) - F.col("hl")})
    value = lambda g, h: gain(g, h, lam, alpha, delta)
    score = 0.5 * (value(F.col("gl"), F.col("hl")) + value(F.col("gr"), F.col("hr")) - value(g_node, h_node))
    return own.select("node", "feature", F.col("bin").alias("cand"), "gl", "hl", "gr", "hr", score.alias("score"), "gn", "hn")


def best(scored: DataFrame) -> DataFrame:
    """Each node's best candidate: of equals the first feature's lowest."""
    order = Window.partitionBy("node").orderBy(F.desc("score"), "feature", "cand")
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def event_counts(rows: DataFrame, feature: str, bins: Column, label: str = "y") -> DataFrame:
    """Events and non-events of each bin of a feature."""
    return rows.select(F.lit(feature).alias("feature"), bins.alias("bin"), F.col(label).alias("y")).where("bin is not null").groupBy("feature", "bin").agg(F.sum("y").cast("long").alias("events"), F.sum(1 - F.col("y")).cast("long").alias("others"))


def woe_iv(counts: DataFrame, adjustment: float = 0.5) -> DataFrame:
    """Weight of evidence of each bin and information value of its feature."""
    by = Window.partitionBy("feature")
    e, n = F.col("events"), F.col("others")
    total_e, total_n = F.greatest(F.sum("events").over(by), F.lit(1)), F.greatest(F.sum("others").over(by), F.lit(1))
    odd = (e == 0) | (n == 0)
    rate_e = F.when(odd, (e + adjustment) / total_e).otherwise(e / total_e)
    rate_n = F.when(odd, (n + adjustment) / total_n).otherwise(n / total_n)
    out = counts.withColumn("rate_e", rate_e).withColumn("rate_n", rate_n).withColumn("woe", F.log(F.col("rate_e") / F.col("rate_n")))
    out = out.withColumn("iv_bin", (F.col("rate_e") - F.col("rate_n")) * F.col("woe"))
    return out.withColumn("iv", F.sum("iv_bin").over(by)).drop("rate_e", "rate_n")


def joined_counts(features: DataFrame, labels: DataFrame, key: str, feature: str, bins: Column, label: str = "y") -> DataFrame:
    """Events and non-events of each bin, the labels being another table that shares a key."""
    return event_counts(features.join(labels.select(key, F.col(label).cast("int").alias(label)), key), feature, bins, label)


def converted(rows: DataFrame, points: dict[str, Sequence[float]], woe: DataFrame | None = None) -> DataFrame:
    """``rows`` with each feature of ``points`` replaced by its right-closed bin, or by its bin's weight of evidence where ``woe`` (feature, bin, woe) is given.

    Bins without a weight, and missing values, become null.
    """
    weights: dict[str, dict[int, float]] = {f: {} for f in points}
    for r in woe.where(F.col("feature").isin(list(points))).select("feature", "bin", "woe").collect() if woe is not None else ():  # a row a bin
        weights[r["feature"]][r["bin"]] = r["woe"]
    new = {}
    for f, p in points.items():
        x = F.col(f).cast("double")
        bin_ = F.when(x.isNotNull() & ~F.isnan(x), bisect_left(x, p))
        values = F.array(*[F.lit(weights[f].get(b)).cast("double") for b in range(len(p))])
        new[f] = bin_ if woe is None else F.get(values, bin_)
    return rows.withColumns(new)


def shuffled_bins(counts: DataFrame, seed: int = 0) -> DataFrame:
    """``counts`` (feature, bin, ...) with bins renumbered in a keyed pseudorandom order, so that they tell nothing of the values behind them."""
    order = Window.partitionBy("feature").orderBy(F.xxhash64("feature", "bin", F.lit(seed)), "bin")
    return counts.withColumn("bin", (F.row_number().over(order) - 1).cast("int"))
