"""All quantiles at once by the exponential mechanism, exactly, over the gaps between data values.

A draw picks a gap for every quantile, in order, and a uniform value in it.  Its
log-weight is the gaps' log-widths less epsilon/4 times the sum of |rows between
neighbouring quantiles - rows wanted there|; a gap picked k times counts 1/k!.

Going forward, the weight of all beginnings that end in a gap needs the sum
over the gaps before it of weight * exp(-rate * |distance - wanted|).  The
absolute value splits it into a running sum up to the rank that lies ``wanted``
behind, and a sum over the stretch from there on.  Such a stretch is the end of
one block of ``wanted`` ranks and the beginning of the next, so sums within
blocks give it without differences.  All sums are of logarithms, within range
partitions and over the short table of partitions and blocks; what lies
``wanted`` behind is looked up by a union with the shifted ranks, in their order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import running, scratch, stored

#: Gaps of a range partition.
PART_ROWS = 100_000
_NONE = -math.inf


def _log_sum(values: np.ndarray, axis: int = 0) -> np.ndarray:
    return np.logaddexp.reduce(values, axis=axis) if values.shape[axis] else np.full(np.delete(values.shape, axis), _NONE)


def gaps(df: DataFrame, column: str, lo: float, hi: float) -> tuple[DataFrame, int]:
    """The gaps between distinct values within the bounds: x, end and r (values up to x); and the number of values.  Null and NaN are no values."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    x = x.select(F.least(F.greatest("x", F.lit(float(lo))), F.lit(float(hi))).alias("x"))
    counts = x.groupBy("x").agg(F.count("*").alias("n"))
    counts = stored(counts.union(df.sparkSession.createDataFrame([(float(lo), 0)], "x double, n long")).groupBy("x").agg(F.sum("n").alias("n")))
    out = running(counts, "x", ["n"], lead=True).select("x", F.coalesce("next", F.lit(float(hi))).alias("end"), F.col("upto_n").alias("r")).where("end > x")
    return out, counts.agg(F.sum("n")).first()[0] or 0


def _parted(df: DataFrame, by: str, parts: int) -> DataFrame:
    return stored(df.repartitionByRange(parts, by).withColumn("_p", F.spark_partition_id()))


def _sums(table: DataFrame, rate: float, wanted: float) -> DataFrame:
    """Adds upto (log-sum of a + rate * r over the gaps so far), and within the block of ``wanted`` ranks: ahead (of a - rate * r over the gaps before) and on (from the gap itself on), by block number b."""

    def totals(g: pd.DataFrame) -> pd.DataFrame:
        r, a = g["r"].to_numpy(), g["a"].to_numpy()
        b = np.floor(r / wanted).astype(np.int64)
        rows = [(int(g["_p"].iloc[0]), -1, float(_log_sum(a + rate * r)))]
        rows += [(int(g["_p"].iloc[0]), int(k), float(_log_sum((a - rate * r)[b == k]))) for k in np.unique(b)]
        return pd.DataFrame(rows, columns=["_p", "b", "s"])

    short = table.select("_p", "r", "a").groupBy("_p").applyInPandas(totals, "_p int, b long, s double").toPandas()  # a row for each partition and block
    short = short.sort_values(["b", "_p"])
    upto, ahead, on = {}, {}, {}
    for k, g in short.groupby("b"):
        s = g["s"].to_numpy()
        before = np.concatenate([[_NONE], np.logaddexp.accumulate(s)[:-1]])
        behind = np.concatenate([np.logaddexp.accumulate(s[::-1])[::-1][1:], [_NONE]])
        for p, u, v in zip(g["_p"], before, behind):
            if k == -1:
                upto[p] = u
            else:
                ahead[p, k], on[p, k] = u, v

    def within(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("r")
        p, r, a = int(g["_p"].iloc[0]), g["r"].to_numpy(), g["a"].to_numpy()
        b = np.floor(r / wanted).astype(np.int64)
        g = g.assign(upto=np.logaddexp(upto[p], np.logaddexp.accumulate(a + rate * r)), ahead=_NONE, on=_NONE, b=b)
        first, rest = np.empty(len(g)), np.empty(len(g))
        for k in np.unique(b):
            at, v = b == k, (a - rate * r)[b == k]
            first[at] = np.logaddexp(ahead[p, k], np.concatenate([[_NONE], np.logaddexp.accumulate(v)[:-1]]))
            rest[at] = np.logaddexp(on[p, k], np.logaddexp.accumulate(v[::-1])[::-1])
        return g.assign(ahead=first, on=rest)

    return table.groupBy("_p").applyInPandas(within, "x double, end double, r long, w double, alphas array<double>, a double, _p int, upto double, ahead double, on double, b long")


def _behind(summed: DataFrame, wanted: float, parts: int) -> DataFrame:
    """For every gap (r): upto of the last gap at least ``wanted`` ranks behind, and on of the first gap behind that, with its block."""
    none = F.lit(None).cast("double")
    table = summed.select(F.col("r").cast("double").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("of"), "upto", F.struct("on", "b").alias("next"))
    asked = summed.select((F.col("r") - wanted).alias("pos"), F.lit(1).alias("kind"), F.col("r").alias("of"), none.alias("upto"), F.lit(None).cast("struct<on:double,b:bigint>").alias("next"))
    rows = _parted(table.union(asked), "pos", parts)
    order = F.when(F.col("kind") == 0, F.col("pos"))
    short = rows.groupBy("_p").agg(F.max_by("upto", order).alias("last"), F.min_by("next", order).alias("first"))
    up, down = Window.orderBy("_p"), Window.orderBy(F.desc("_p"))  # a row for each partition
    earlier = Window.unboundedPreceding, -1
    short = short.select("_p", F.last("last", True).over(up.rowsBetween(*earlier)).alias("last"), F.last("first", True).over(down.rowsBetween(*earlier)).alias("first"))
    own = Window.partitionBy("_p").orderBy("pos", "kind")
    seen = F.last("upto", True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    # downwards, as a frame that ends at the partition's end would be gone through anew for every row
    coming = F.last("next", True).over(Window.partitionBy("_p").orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(*earlier))
    out = rows.withColumns({"seen": seen, "coming": coming}).where("kind = 1").join(F.broadcast(short), "_p")
    return out.select(F.col("of").alias("r"), F.coalesce("seen", "last").alias("seen"), F.coalesce("coming", "first").alias("coming"))


def forward(table: DataFrame, n: int, qs: Sequence[float], epsilon: float) -> list[DataFrame]:
    """For every quantile the gaps with the log-weight of all beginnings whose last quantile lies there: x, end, r, w, a, and alphas, by how many of the last ones share the gap."""
    rate, wanted = epsilon / 4, np.diff([0.0, *qs]) * n
    parts = max(1, -(-table.count() // PART_ROWS))
    none = F.lit(_NONE)
    first = table.withColumn("w", F.log(F.col("end") - F.col("x"))).withColumn("a", F.col("w") - rate * F.abs(F.col("r") - float(wanted[0])))
    out = [_parted(first.select("x", "end", "r", "w", F.array("a").alias("alphas"), "a"), "r", parts)]
    log_add = lambda a, b: F.when(a == none, b).when(b == none, a).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))
    for step in map(float, wanted[1:]):
        summed = stored(_sums(out[-1], rate, step))
        met = summed.join(_behind(summed, step, parts), "r")
        far = F.coalesce("seen", none) - rate * (F.col("r") - step)
        near = log_add(F.col("ahead"), F.when(F.col("coming.b") == F.col("b") - 1, F.col("coming.on")).otherwise(none)) - rate * (step - F.col("r"))
        alone = F.col("w") + log_add(far, near)
        shared = F.transform("alphas", lambda a, k: a + F.col("w") - F.log(k + 2.0) - rate * step)
        met = met.select("x", "end", "r", "w", F.concat(F.array(alone), shared).alias("alphas"))
        top = F.array_max("alphas")
        whole = top + F.log(F.aggregate("alphas", F.lit(0.0), lambda s, a: s + F.exp(a - top)))
        out.append(_parted(met.withColumn("a", F.when(top == none, none).otherwise(whole)), "r", parts))
    return out


def drawn(tables: Sequence[DataFrame], n: int, qs: Sequence[float], epsilon: float, seed: int = 0) -> list[float]:
    """A draw of all quantiles, backwards: the last one's gap by a racing minimum over all gaps, how many share it, and so on before it."""
    rate, wanted, rng = epsilon / 4, np.diff([0.0, *qs, 1.0]) * n, np.random.default_rng(seed)
    out, j, above = [], len(qs), n
    while j:
        u = (F.pmod(F.xxhash64("r", F.lit(j), F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
        term = F.col("a") - rate * F.abs(F.lit(above) - F.col("r") - float(wanted[j]))
        rows = tables[j - 1].where(F.col("a") > F.lit(_NONE))
        rows = rows if j == len(qs) else rows.where(F.col("r") < above)
        got = rows.agg(F.min_by(F.struct("x", "end", "r", "alphas"), F.log(-F.log(u)) - term).alias("g")).first()["g"]
        alphas = np.array(got["alphas"])
        shared = 1 + int(np.argmax(alphas + rng.gumbel(size=len(alphas))))
        out += (got["x"] + (got["end"] - got["x"]) * rng.random(shared)).tolist()
        j, above = j - shared, got["r"]
    return sorted(out)


def joint_exp(df: DataFrame, column: str, qs: Sequence[float], lo: float, hi: float, epsilon: float, seed: int = 0) -> list[float]:
    """All quantiles ``qs`` (different ones) of a column within bounds, at ``epsilon`` together under swaps of rows; without values, of an even spread."""
    qs = sorted(qs)
    if len(set(qs)) < len(qs) or not 0 < qs[0] <= qs[-1] < 1:
        raise ValueError("quantiles must be different, and between 0 and 1")
    with scratch(df.sparkSession):
        table, n = gaps(df, column, lo, hi)
        if not n:
            return sorted(np.random.default_rng(seed).uniform(lo, hi, len(qs)).tolist())
        return drawn(forward(stored(table), n, qs, epsilon), n, qs, epsilon, seed)
