"""Datasets by name: how each is read, its label, and what is dropped; results and their files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """A delimited file: separator, header, the label's rule, dropped columns, the token of missing values, what stands for it (null by default), whether columns with missing values are left out."""

    label: Callable[[DataFrame], Column]
    sep: str = ","
    header: bool = True
    drop: tuple[str, ...] = ()
    missing: str | None = None
    fill: float | None = None
    complete: bool = False
    encode: bool = False
    options: dict = field(default_factory=dict)


_is = lambda c, *values: lambda df: F.col(c).isin(*values).cast("int")
#: The tabular learning sets and their rules.
DATASETS = {
    "credit1": Dataset(lambda df: F.col("SeriousDlqin2yrs").cast("int"), drop=("Unnamed: 0", "_c0", "SeriousDlqin2yrs"), missing="NA"),
    "credit2": Dataset(lambda df: F.col("`default.payment.next.month`").cast("int"), drop=("ID", "default.payment.next.month")),
    "credit_card": Dataset(lambda df: F.col("Class").cast("int"), drop=("Class",)),
    "sensor": Dataset(lambda df: (F.col("_c48").cast("double") <= 1).cast("int"), sep=" ", header=False, drop=("_c48",)),
    "nomao": Dataset(lambda df: F.when(F.col("_c119").cast("int") == 1, 0).otherwise(1), header=False, drop=("_c119",), missing="?", complete=True),
    "adult": Dataset(lambda df: F.trim("_c14").startswith(">").cast("int"), header=False, drop=("_c14",), missing=" ?", encode=True),
    "higgs": Dataset(lambda df: F.col("_c1").cast("int"), header=False, drop=("_c0", "_c1")),
    "diabetes": Dataset(_is("readmitted", "<30", ">30"), drop=("readmitted", "encounter_id", "patient_nbr"), encode=True),
    "aps": Dataset(_is("class", "pos"), drop=("class",), missing="na", fill=-1.0),
    "bank": Dataset(_is("y", "yes"), sep=";", drop=("y",), encode=True),
}


def load(spark: SparkSession, name: str, path: str, remove_missing: bool = False) -> DataFrame:
    """A dataset with ``y`` first and its features after it, all strings that hold numbers cast to double, others coded by sorted value."""
    from ..operators.sampling import sorted_codes

    d = DATASETS[name]
    reader = spark.read.option("header", d.header).option("sep", d.sep)
    reader = reader.option("nullValue", d.missing) if d.missing else reader
    raw = reader.options(**d.options).csv(path)
    if remove_missing:
        raw = raw.dropna()
    df = raw.withColumn("__label", d.label(raw)).drop(*d.drop)
    features = [c for c in df.columns if c != "__label"]
    if d.encode:
        for c in features:
            df = sorted_codes(df, c, f"{c}__code").drop(c).withColumnRenamed(f"{c}__code", c)
    else:
        df = df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in features})
        if d.complete:
            kept = complete_columns(df.select(*[F.col(f"`{c}`") for c in features]))
            features = [c for c in features if c in kept]
        if d.fill is not None:
            df = df.fillna(d.fill, features)
    return df.select(F.col("__label").alias("y"), *[F.col(f"`{c}`") for c in features])


def complete_columns(df: DataFrame, missing: str | None = None) -> list[str]:
    """The columns in which no row is null or has the token of missing values: one pass over all of them."""
    lacks = [F.col(f"`{c}`").isNull() if missing is None else (F.col(f"`{c}`") == missing) | F.col(f"`{c}`").isNull() for c in df.columns]
    row = df.agg(*[F.count_if(x).alias(c) for c, x in zip(df.columns, lacks)]).first()
    return [c for c in df.columns if not row[c]]


def quantile_column(spark: SparkSession, path: str, column: str, divisor: float = 1.0) -> DataFrame:
    """One column of a delimited file as numbers ``x``, divided; what is no number is left out."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select((F.expr(f"try_cast(trim(`{column}`) AS double)") / divisor).alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))


def synthetic(spark: SparkSession, rows: int, features: int, informative: int, seed: int = 0, share: float = 0.3) -> DataFrame:
    """Two classes that differ in the means of the informative features; row_id, features f0.., y."""
    base = spark.range(rows).withColumnRenamed("id", "row_id").withColumn("y", (F.rand(seed) < share).cast("int"))
    return base.select("row_id", *[(F.randn(seed + 1 + j) + (F.col("y") * 2 - 1) * (0.8 if j < informative else 0.0)).alias(f"f{j}") for j in range(features)], "y")


def with_noise(df: DataFrame, columns: int = 40, scale: float = 1000.0, seed: int = 0) -> DataFrame:
    """Adds columns of pure noise."""
    return df.select("*", *[(F.randn(seed + i) * scale).alias(f"noise{i}") for i in range(columns)])


def write_results(df: DataFrame, path: str) -> None:
    """Appends experiment results, one file set a call, so that a run that ends early keeps what it had."""
    df.write.mode("append").parquet(path)


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """All results of several folders; columns that some lack are null there."""
    first, *rest = [spark.read.parquet(p) for p in paths]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
