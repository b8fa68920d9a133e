"""Gradient histograms and event counts over streams: sums merge, so late data only add to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.binning import bin_of


def windowed_bins(stream: DataFrame, time: str, value: str, cands: Sequence[float], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and bin; state is dropped once the watermark has passed a window."""
    binned = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(F.window(time, width).alias("w"), bin_of(F.col(value).cast("double"), cands).alias("bin"))
    return binned.where("bin is not null").groupBy("w", "bin").agg(F.count("*").alias("n")).select("w.start", "w.end", "bin", "n")
