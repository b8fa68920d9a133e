"""Runs of many settings at the same time, each committed by itself, so that a sweep that was broken off goes on where it stopped."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from . import trees


def name_of(setting: dict) -> str:
    """A setting's name: a digest of its values, whatever their order."""
    return hashlib.sha256(json.dumps(setting, sort_keys=True, default=str).encode()).hexdigest()[:24]


def committed(spark: SparkSession, path: str) -> set[str]:
    """Names of the settings whose row is complete at ``path``: a folder each, with Spark's mark of success."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return set()
    return {p.getName() for p in (s.getPath() for s in fs.listStatus(at)) if fs.exists(p.suffix("/_SUCCESS"))}


def sweep(spark: SparkSession, settings: Iterable[dict], job: Callable[[dict], dict], path: str, schema: str, parallel: int = 4) -> DataFrame:
    """Runs ``job`` for every setting that has no row at ``path`` yet, and returns the rows of all settings.

    ``job`` turns a setting into a row of ``schema``; ``setting`` (as JSON) and
    ``seconds`` are added.  ``parallel`` jobs run at the same time, each in a
    scheduler pool of its own, so that with FAIR scheduling none waits for
    another's last task.  A row is written when its job ends; after an error
    the rows of finished jobs stay, running jobs end, and no new one begins.
    """
    wanted = {name_of(s): s for s in settings}
    done, failed = committed(spark, path), []
    whole = f"setting string, {schema}, seconds double"

    def one(name: str, setting: dict) -> None:
        if failed:
            return
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sweep-{name[:8]}")
            began = time.perf_counter()
            row = job(setting) | {"setting": json.dumps(setting, sort_keys=True, default=str)}
            row["seconds"] = time.perf_counter() - began
            spark.createDataFrame([row], whole).coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
        except Exception as e:
            failed.append(e)
            raise

    with ThreadPoolExecutor(parallel) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(one), name, s) for name, s in wanted.items() if name not in done]
    for r in running:
        r.result()
    paths = [f"{path}/{name}" for name in wanted]
    return spark.read.schema(whole).json(paths) if paths else spark.createDataFrame([], whole)


#: Columns of a training run's row.
RUN = "trees int, train_auc double, test_auc double, test_ap double, test_accuracy double, test_f1 double, rounds_sent long, bytes_sent long, epsilon_spent double"


def train_sweep(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str | None, settings: Iterable[dict], path: str, parallel: int = 4) -> DataFrame:
    """A row for every setting (of ``trees.Params``): trees, how well they tell two classes apart, what growing told, what it spent."""
    spark = train.sparkSession

    def scored(model: trees.Model, df: DataFrame) -> DataFrame:
        return model.score(df).select(F.col(label).alias("y"), F.col("probabilities")[1].alias("score"), "prediction")

    def job(setting: dict) -> dict:
        model = trees.fit(train, features, label, key, trees.Params(**setting))
        on_test = scored(model, test)
        told = model.told(spark).where("direction = 'sent'").agg(F.sum("rounds").alias("r"), F.sum("bytes").alias("b")).first()
        right = metrics.confusion(on_test).first()
        row = {"trees": sum(map(len, model.trees.values())), "train_auc": metrics.auc(scored(model, train)).first()["auc"], "test_auc": metrics.auc(on_test).first()["auc"], "test_ap": metrics.average_precision(on_test).first()["ap"]}
        return row | {"test_accuracy": right["accuracy"], "test_f1": right["f1"], "rounds_sent": told["r"], "bytes_sent": told["b"], "epsilon_spent": model.spent}

    return sweep(spark, settings, job, path, RUN, parallel)
