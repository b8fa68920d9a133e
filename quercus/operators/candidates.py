"""Split candidates of each type: from aggregates of a bounded size to sorted thresholds."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import at_ranks, running, stored


#: Thresholds that a categorical feature may have.
MOST_CATEGORIES = 100_000


def _valid(df: DataFrame, f: str) -> DataFrame:
    return df.select(F.col(f).cast("double").alias("x")).where("x is not null and not isnan(x)")


def ranges(df: DataFrame, features: Sequence[str], multiplier: float = 1.0) -> dict[str, tuple[float, float]]:
    """Range of every feature in one pass; NaN is no value."""
    clean = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    row = df.agg(*[a for i, f in enumerate(features) for a in (F.min(clean[f]).alias(f"lo{i}"), F.max(clean[f]).alias(f"hi{i}"))]).first()
    out = {}
    for i, f in enumerate(features):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:  # no values
            out[f] = None, None
            continue
        out[f] = (lo * multiplier if lo <= 0 else lo / multiplier, hi * multiplier)
    return out


def linspace(lo: float, hi: float, q: int) -> list[float]:
    """``q`` points from ``lo``, ``hi`` left out."""
    step = (hi - lo) / q
    return [hi] * q if lo == hi else [lo + i * step for i in range(q)]


def uniform(df: DataFrame, features: Sequence[str], q: int = 32, multiplier: float = 1.0) -> dict[str, list[float]]:
    return {f: linspace(lo, hi, q) for f, (lo, hi) in ranges(df, features, multiplier).items()}


def exact_quantiles(df: DataFrame, features: Sequence[str], q: int = 32) -> dict[str, list[float]]:
    """Linear quantiles at i/q, exact: distinct values are counted, ranked by running sums, and looked up at the ranks around each quantile."""
    values = F.explode(F.array(*[F.struct(F.lit(j).alias("feature"), F.col(f).cast("double").alias("x")) for j, f in enumerate(features)])).alias("v")
    counts = stored(df.select(values).select("v.*").where("x is not null and not isnan(x)").groupBy("feature", "x").agg(F.count("*").alias("n")))
    sizes = {r["feature"]: r["n"] for r in counts.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    places = [(j, i, k, rank) for j, n in sizes.items() for i in range(q) for k, rank in enumerate((math.floor(i / q * (n - 1)), math.ceil(i / q * (n - 1))))]
    spots = df.sparkSession.createDataFrame(places, "feature int, i int, k int, at long")
    got = {(r["feature"], r["i"], r["k"]): r["x"] for r in at_ranks(counts, spots, ["feature"]).collect()}  # two rows a quantile
    out = {f: [] for f in features}
    for j, n in sizes.items():
        for i in range(q):
            lo, hi, place = got[j, i, 0], got[j, i, 1], i / q * (n - 1)
            out[features[j]].append(lo + (hi - lo) * (place - math.floor(place)))
    return out


def sketch(df: DataFrame, features: Sequence[str], q: int = 32, error: float = 0.001) -> dict[str, list[float]]:
    """Quantiles i/q of a mergeable sketch with rank error ``error``, without repeats."""
    rates = [(i + 1) / q for i in range(q)]
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), rates, int(1 / error)).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return {f: sorted(set(row[f"q{i}"])) for i, f in enumerate(features)}


def exact_icdf(df: DataFrame, feature: str, q: int = 32) -> list[float]:
    """The inverse of the empirical distribution function, interpolated between distinct values, at i/q.

    A running sum over the distinct values, partition by partition, finds the
    neighbours of every rate; a row for each rate comes back.
    """
    counts = _valid(df, feature).groupBy("x").agg(F.count("*").alias("n"))
    n_all, distinct, least = counts.agg(F.sum("n"), F.count("*"), F.min("x")).first()
    if distinct <= 2:
        return [least]
    upto = stored(running(counts, "x", ["n"], lead=True))
    behind = upto.select(F.col("x").alias("next"), F.col("n").alias("next_n"))
    at = upto.join(behind, "next", "left").select("x", (F.col("upto_n") / F.lit(n_all)).alias("p"), F.col("next").alias("next_x"), ((F.col("upto_n") + F.col("next_n")) / F.lit(n_all)).alias("next_p"))
    rates = df.sparkSession.createDataFrame([(i, i / q) for i in range(q)], "i int, r double")
    (x0, p0), (x1, p1) = at.select("x", "p").orderBy("x").limit(2).collect()
    hit = at.where("next_x is not null").join(F.broadcast(rates), (F.col("r") >= F.col("p")) & (F.col("r") < F.col("next_p")))
    got = {r["i"]: r["v"] for r in hit.select("i", (F.col("x") + (F.col("r") - F.col("p")) * (F.col("next_x") - F.col("x")) / (F.col("next_p") - F.col("p"))).alias("v")).collect()}
    return [got.get(i, x0 + (i / q - p0) * (x1 - x0) / (p1 - p0)) for i in range(q)]


def _log_points(lo: float, hi: float, skew: float, q: int) -> list[float]:
    top = math.log1p(hi - lo)
    points = [math.exp(v) + lo - 1 for v in linspace(0.0, top, q)]
    return sorted(points if skew >= 0 else [lo + hi - p for p in points])


def log(df: DataFrame, feature: str, q: int = 32) -> list[float]:
    """Points even on a logarithmic scale, mirrored for a negative skew."""
    lo, hi, skew = _valid(df, feature).agg(F.min("x"), F.max("x"), F.skewness("x")).first()
    return _log_points(lo, hi, skew, q)


def log_uniform(df: DataFrame, feature: str, q: int = 32) -> list[float]:
    """Half of the points logarithmic, half uniform."""
    lo, hi, skew = _valid(df, feature).agg(F.min("x"), F.max("x"), F.skewness("x")).first()
    return sorted(_log_points(lo, hi, skew, q // 2) + linspace(lo, hi, q // 2))


def skew_z(skewness: float, n: int) -> float:
    """The z-score of a sample skewness under normality (D'Agostino's transformation)."""
    y = skewness * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    a = math.sqrt(2.0 / (w2 - 1))
    y = y or 1.0
    return math.log(y / a + math.sqrt((y / a) ** 2 + 1)) / math.sqrt(0.5 * math.log(w2))


def skew_test(df: DataFrame, feature: str, q: int = 32, level: float = 0.05) -> list[float]:
    """Logarithmic points where the skew is significant, uniform ones otherwise."""
    lo, hi, skew, n = _valid(df, feature).agg(F.min("x"), F.max("x"), F.skewness("x"), F.count("*")).first()
    p = math.erfc(abs(skew_z(skew, n)) / math.sqrt(2)) if n >= 8 else 1.0
    return _log_points(lo, hi, skew, q) if p <= level else linspace(lo, hi, q)


def categorical(df: DataFrame, feature: str) -> list[float]:
    """The distinct values of a categorical feature; more than ``MOST_CATEGORIES`` are an error, since thresholds live on the driver."""
    found = [r[0] for r in _valid(df, feature).distinct().limit(MOST_CATEGORIES + 1).collect()]
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"{feature}: more than {MOST_CATEGORIES} categories")
    return sorted(found)


def random_points(df: DataFrame, features: Sequence[str], q: int = 32, seed: int = 0) -> dict[str, list[float]]:
    rng = random.Random(seed)
    return {f: sorted(rng.uniform(lo, hi) for _ in range(q)) for f, (lo, hi) in ranges(df, features).items()}


def counted_quantiles(counts: Sequence[float], edges: Sequence[float], q: int) -> list[float]:
    """Quantiles (k+1)/q of a histogram of shares; the fraction within a bin is measured from the overshoot."""
    total = sum(counts) or 1.0
    cumulative = [c / total for c in itertools.accumulate(counts)]
    out = []
    for k in range(q):
        target = (k + 1) / q
        b = next((i for i, c in enumerate(cumulative) if c >= target), len(counts) - 1)
        over = (cumulative[b] - target) * q if cumulative[b] > target else 0.0
        out.append(edges[b] if b == len(counts) - 1 else edges[b] + (edges[b + 1] - edges[b]) * over)
    return out


def histogram_quantiles(df: DataFrame, feature: str, q: int = 32, bins: int = 1024, epsilon: float = 0.0, seed: int = 0) -> list[float]:
    """Quantiles of an equal-width histogram, with Laplace noise of scale 1/epsilon on its counts if epsilon is given."""
    (lo, hi) = ranges(df, [feature])[feature]
    width = (hi - lo) / bins
    cell = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)) if width else F.lit(0)
    got = dict(_valid(df, feature).groupBy(cell.cast("int").alias("b")).count().collect())
    rng = random.Random(seed)
    laplace = lambda: rng.expovariate(epsilon) - rng.expovariate(epsilon) if epsilon else 0.0
    counts = [max(0.0, got.get(i, 0) + laplace()) for i in range(bins)]
    return counted_quantiles(counts, [lo + i * width for i in range(bins + 1)], q)


def hessian_refined(cands: Sequence[float], hessians: Sequence[float], mean_total: float, q: int) -> list[float]:
    """Candidates of the next round: light bins are merged, heavy ones halved, and too few are padded evenly.

    ``hessians`` is the root histogram of the feature, ``mean_total`` the mean over features of its unclipped sum.
    """
    limit, held, new = mean_total / q, 0.0, []
    last = len(cands) - 1
    for i, h in enumerate(max(0.0, x) for x in hessians):
        held += h
        if i < last and held > limit:
            new.append(cands[i])
            held = 0.0
            if len(cands) < q and len(new) < q:
                new.append((cands[i] + cands[i + 1]) / 2)
        elif i == last:
            new.append(cands[i])
    new = sorted(set(new))
    if new and len(new) < q:
        k = math.ceil(q / len(new))
        new = sorted({*new, *(p for a, b in zip(new, new[1:]) for p in linspace(a, b, k))})
    return new
