"""Metrics of scored tables, over distinct scores: an aggregate first, windows over the short table after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running


def _by_score(df: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))


def auc(df: DataFrame, label: str = "y", score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting half; null where a class is missing."""
    keys = keys or []
    counts = running(_by_score(df, label, score, keys), score, ["n"], keys)
    wins = F.sum(F.col("p") * (F.col("upto_n") - F.col("n") / 2))
    return counts.groupBy(*keys).agg((wins / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def class_auc(df: DataFrame, label: str, scores: str, classes: int) -> DataFrame:
    """Each class against the rest: class and auc, ``scores`` being an array of a score for each class."""
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(c.alias("class"), (F.col(label) == c).cast("int").alias("y"), F.get(scores, c).alias("score")))).alias("e")
    return auc(df.select(each).select("e.*"), keys=["class"])


def average_precision(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Sum over distinct thresholds of the gain in recall times precision."""
    c = running(_by_score(df, label, score, []), score, ["p", "n"], descending=True)
    return c.agg((F.sum(F.col("p") * F.col("upto_p") / (F.col("upto_p") + F.col("upto_n"))) / F.sum("p")).alias("ap"))


def roc(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """False and true positives at every distinct threshold."""
    return running(_by_score(df, label, score, []), score, ["p", "n"], descending=True).select(score, F.col("upto_n").alias("fp"), F.col("upto_p").alias("tp"))


def report(df: DataFrame, label: str = "y", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    sides = F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("own"), F.lit(0).alias("told")), F.struct(F.col(prediction).alias("class"), F.lit(0).alias("own"), F.lit(1).alias("told")))).alias("s")
    n = df.select(sides, (F.col(label) == F.col(prediction)).cast("int").alias("right")).select("s.*", "right").groupBy("class").agg(F.sum("own").alias("support"), F.sum("told").alias("told"), F.sum(F.col("own") * F.col("right")).alias("hits"))
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    return n.select("class", part("hits", F.col("told")).alias("precision"), part("hits", F.col("support")).alias("recall"), (2 * F.col("hits") / (F.col("told") + F.col("support"))).alias("f1"), "support")


def confusion(df: DataFrame, label: str = "y", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; what nothing is in is 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    s = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count("*").alias("rows"), F.count_if(y == p).alias("right"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(part(F.col("right"), F.col("rows")).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


def regression(df: DataFrame, label: str = "y", prediction: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(prediction)
    return df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(label) * F.count("*"))).alias("r2"))
