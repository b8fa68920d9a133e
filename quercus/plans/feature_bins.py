"""Supervised bins of many columns at once: which columns, how, what came out, and rows turned into bins or weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import binning, candidates, summaries


@dataclass
class BinParams:
    """How columns are binned.

    ``bin_names`` and ``bin_indexes`` (places among the columns) choose the columns, all numeric ones if
    neither is given; ``category_names`` and ``category_indexes`` take their own values as bins.
    ``transform_names`` and ``transform_indexes`` choose among these what ``BinResult.transform`` replaces (all if
    neither is given), by ``transform_type``: "bin_num", "woe" or None.
    Values in ``abnormal`` are in no bin, and rows keep them as they are.
    """

    method: str = "quantile"
    bin_num: int = 10
    error: float = 0.001
    bin_names: Sequence[str] = ()
    bin_indexes: Sequence[int] = ()
    category_names: Sequence[str] = ()
    category_indexes: Sequence[int] = ()
    transform_names: Sequence[str] = ()
    transform_indexes: Sequence[int] = ()
    transform_type: str | None = "bin_num"
    adjustment_factor: float = 0.5
    abnormal: Sequence[float] = ()
    skip_static: bool = False


def _named(header: Sequence[str], names: Sequence[str], indexes: Sequence[int]) -> list[str]:
    """Columns by name and by place, each once, in the order in which they are asked for by place, then by name."""
    if unknown := [i for i in indexes if not 0 <= i < len(header)]:
        raise ValueError(f"no columns at {unknown}")
    if unknown := [n for n in names if n not in header]:
        raise ValueError(f"no columns {unknown}")
    return list(dict.fromkeys([*[header[i] for i in indexes], *names]))


@dataclass
class Columns:
    """The columns that are binned, those of them that are categories, and those that rows get replaced."""

    bins: list[str]
    categories: list[str]
    transform: list[str] = field(default_factory=list)

    @classmethod
    def chosen(cls, header: Sequence[str], p: BinParams) -> Columns:
        categories = _named(header, p.category_names, p.category_indexes)
        asked = _named(header, p.bin_names, p.bin_indexes) or list(header)
        bins = [c for c in asked if c not in categories]
        transform = _named(header, p.transform_names, p.transform_indexes) or [*bins, *categories]
        if unknown := [c for c in transform if c not in bins and c not in categories]:
            raise ValueError(f"columns {unknown} have no bins")
        return cls(bins, categories, transform)


def _own(c: str, abnormal: Sequence[float]) -> Column:
    x = F.col(c).cast("double")
    return F.when(~x.isin(*map(float, abnormal)), x) if abnormal else x


def _bin(x: Column, points: Sequence[float]) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x), binning.bisect_left(x, points)) if len(points) > 1 else F.when(x.isNotNull() & ~F.isnan(x), F.lit(0))


@dataclass
class BinResult:
    """Split points by column, and a table of what is in their bins: feature, bin, point (its upper end), events, others, event_rate, other_rate, woe, iv_bin, iv, monotonic."""

    params: BinParams
    columns: Columns
    points: dict[str, list[float]]
    table: DataFrame | None

    def ivs(self) -> DataFrame:
        """Information value of each feature, and whether its weights rise or fall all along."""
        return self.table.groupBy("feature").agg(F.first("iv").alias("iv"), F.first("monotonic").alias("monotonic"), F.count("*").alias("bins"))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the chosen columns replaced; missing values become null, abnormal ones stay."""
        p = self.params
        if p.transform_type is None:
            return df
        weights: dict[str, dict[int, float]] = {c: {} for c in self.columns.transform}
        if p.transform_type == "woe":
            for r in self.table.where(F.col("feature").isin(self.columns.transform)).select("feature", "bin", "woe").collect():  # a row a bin
                weights[r["feature"]][r["bin"]] = r["woe"]
        new = {}
        for c in self.columns.transform:
            at = _bin(_own(c, p.abnormal), self.points[c])
            value = at.cast("double") if p.transform_type == "bin_num" else F.get(F.array(*[F.lit(weights[c].get(b)).cast("double") for b in range(len(self.points[c]))]), at)
            x = F.col(c).cast("double")
            new[c] = F.when(x.isin(*map(float, p.abnormal)), x).otherwise(value) if p.abnormal else value
        return df.withColumns(new)


def fit_bins(df: DataFrame, label: str | None, params: BinParams | None = None) -> BinResult:
    """Bins of the columns of ``df`` (``label``, 0 or 1, is none of them): split points in one pass, counts of all columns in another.

    "quantile" takes points from a mergeable sketch, "bucket" evenly between least and most.  Bins are
    right-closed, the last one is open.  Without a label, or with ``skip_static``, there is no table.
    """
    p = params or BinParams()
    if p.method not in ("quantile", "bucket"):
        raise ValueError(f"unknown binning method {p.method}")
    if p.transform_type not in ("bin_num", "woe", None) or p.transform_type == "woe" and (p.skip_static or label is None):
        raise ValueError(f"transform type {p.transform_type}")
    header = [c for c, t in df.dtypes if c != label and (t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or t.startswith("decimal"))]
    columns = Columns.chosen(header, p)
    clean = df.select(*[_own(c, p.abnormal).alias(c) for c in [*columns.bins, *columns.categories]], *([F.col(label).cast("int").alias("_y")] if label else []))
    if p.method == "quantile":
        points = summaries.split_points(clean, columns.bins, p.bin_num, p.error)
    else:
        ends = candidates.ranges(clean, columns.bins) if columns.bins else {}
        points = {c: candidates.linspace(lo, hi, p.bin_num)[1:] + [hi] if lo is not None else [] for c, (lo, hi) in ends.items()}
    points |= {c: candidates.categorical(clean, c) for c in columns.categories}
    if label is None or p.skip_static:
        return BinResult(p, columns, points, None)
    names = [*columns.bins, *columns.categories]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _bin(F.col(c), points[c]).cast("int").alias("bin")) for c in names])).alias("b")
    counts = clean.select("_y", each).select("_y", "b.*").where("bin is not null and _y is not null")
    counts = counts.groupBy("feature", "bin").agg(F.sum("_y").cast("long").alias("events"), F.sum(1 - F.col("_y")).cast("long").alias("others"))
    by = Window.partitionBy("feature")
    weighed = binning.woe_iv(counts, p.adjustment_factor)
    rates = {f"{c}_rate": F.col(f"{c}s") / F.greatest(F.sum(f"{c}s").over(by), F.lit(1)) for c in ("event", "other")}
    step = F.col("woe") - F.lag("woe").over(by.orderBy("bin"))
    table = weighed.withColumns(rates | {"_step": step}).withColumn("monotonic", (F.count_if(F.col("_step") > 0).over(by) == 0) | (F.count_if(F.col("_step") < 0).over(by) == 0))
    ends = df.sparkSession.createDataFrame([(c, b, float(v)) for c in names for b, v in enumerate(points[c])], "feature string, bin int, point double")  # as many rows as bins
    table = table.join(F.broadcast(ends), ["feature", "bin"]).select("feature", "bin", "point", "events", "others", "event_rate", "other_rate", "woe", "iv_bin", "iv", "monotonic")
    return BinResult(p, columns, points, table)
