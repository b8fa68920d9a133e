"""Result analytics: parsing of settings, grouped statistics, ranks, pivots, bands; plain DataFrame plans."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def setting(args: str, name: str, default: str | None) -> Column:
    """One value of a dictionary printed as text, without quotes and spaces."""
    found = F.regexp_extract(args, f"'{name}': *('?)([^,'}}]*)\\1", 2)
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), F.lit(default))


#: Columns of a run, the settings they come from, and what holds where a setting isn't named.
RUN_COLUMNS = {
    "dp_method": ("dp_method", None),
    "split_method": ("split_method", None),
    "max_depth": ("max_depth", None),
    "num_trees": ("num_trees", None),
    "epsilon": ("epsilon", None),
    "ebm": ("ebm", "False"),
    "feature_interaction_method": ("feature_interaction_method", "standard"),
    "feature_interaction_k": ("feature_interaction_k", "d"),
    "weight_update": ("weight_update_method", ""),
    "gradient_budgets": ("gradient_budgets", ""),
    "training_method": ("training_method", "boosting"),
    "sketch_type": ("sketch_type", "uniform"),
    "sketch_rounds": ("sketch_rounds", "inf"),
    "quantize_q": ("quantize_q", "float64"),
}


def run_columns(df: DataFrame, args: str = "args") -> DataFrame:
    """Adds what a run's printed settings say: ``RUN_COLUMNS``, vec_mech, batch_size (all trees by default) and batch_perc; columns there already stay."""
    new = {c: setting(args, name, default) for c, (name, default) in RUN_COLUMNS.items() if c not in df.columns}
    if "dp_method" in new:
        new["dp_method"] = F.regexp_replace(new["dp_method"], "^gaussian_cdp$", "DP")
    if "weight_update" in new:
        new["weight_update"] = F.when(setting(args, "training_method", "") == "rf", "rf").otherwise(new["weight_update"])
    out = df.withColumns(new | {"vec_mech": F.when(F.contains(args, F.lit("'vector_mechanism'")), "True").otherwise("False")})
    size = F.coalesce(setting(args, "batched_update_size", None).cast("double"), F.col("num_trees").cast("double"))
    return out.withColumn("batch_size", size).withColumn("batch_perc", F.col("batch_size") / F.col("num_trees").cast("double"))


def overwritten(df: DataFrame, column: str, where: Column, value) -> DataFrame:
    """``column`` set to a value where a condition holds; elsewhere, also where it is unknown, it stays."""
    return df.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def scaled(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Columns in other units, multiplied by their factors."""
    return df.withColumns({c: F.col(c) * f for c, f in factors.items()})


def result_table(df: DataFrame, rows: str, columns: str, heads: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """A table of texts "mean (std)": a row for each value of ``rows``, a column for each head, the best of a column marked with *."""
    cells = flag_best(mean_std(df, [rows, columns], value, digits), [columns])
    number = lambda c: F.format_string(f"%.{digits}f", F.coalesce(F.col(c), F.lit(0.0)))
    text = F.concat(number("mean"), F.lit(" ("), number("std"), F.lit(")"), F.when(F.col("best"), "*").otherwise(""))
    return cells.select(rows, columns, text.alias("cell")).groupBy(rows).pivot(columns, list(heads)).agg(F.max("cell"))


def sweep(df: DataFrame, over: Sequence[str], x: str, hue: str, value: str) -> DataFrame:
    """One curve table for each combination of ``over``, in one plan: mean, spread and runs at every (hue, x)."""
    return df.groupBy(*over, hue, x).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("runs"))


def remapped(column: str, names: dict[str, str]) -> Column:
    """Values renamed; those without a new name stay."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(pairs[F.col(column)], F.col(column))


def mean_std(df: DataFrame, keys: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_samp(value), digits).alias("std"), F.count("*").alias("n"))


def flag_best(means: DataFrame, group: Sequence[str], value: str = "mean") -> DataFrame:
    """Adds ``best``: whether the row has its group's largest value."""
    return means.withColumn("best", F.col(value) == F.max(value).over(Window.partitionBy(*group)))


def best_setting(df: DataFrame, group: Sequence[str], setting_column: str, value: str) -> DataFrame:
    """Rows of each group at the setting of the largest mean; of equals the smallest setting."""
    means = df.groupBy(*group, setting_column).agg(F.avg(value).alias("_m"))
    top = means.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_m"), setting_column))).where("_r = 1")
    return df.join(top.select(*group, setting_column), [*group, setting_column], "left_semi")


def ranks(df: DataFrame, within: Sequence[str], value: str) -> DataFrame:
    """Adds ``rank`` within groups, the largest first, ties getting their average."""
    by = Window.partitionBy(*within)
    ties = F.count("*").over(Window.partitionBy(*within, value))
    return df.withColumn("rank", F.rank().over(by.orderBy(F.desc(value))) + (ties - 1) / 2)


def bands(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mid"))


def on_grid(value: Column, step: float) -> Column:
    return F.bround(value / step) * step


def grid(spark: SparkSession, **settings: Sequence) -> DataFrame:
    """The cross product of experiment settings; a short table."""
    names = list(settings)
    return spark.createDataFrame([tuple(map(str, row)) for row in itertools.product(*settings.values())], [f"{n}" for n in names])


def summed(df: DataFrame, prefix: str, name: str) -> DataFrame:
    """Adds the sum of the columns whose names begin with ``prefix``."""
    columns = [F.col(c) for c in df.columns if c.startswith(prefix)]
    return df.withColumn(name, sum(columns[1:], columns[0]))
