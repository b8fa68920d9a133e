"""Near-duplicate vectors by random hyperplanes: several tables of sign hashes, exact cosines, connected components.

Equal vectors are one class from the start.  In every table a class falls into
the bucket that the signs of its products with random hyperplanes name.  A
bucket is compared block by block, so no task holds more than two blocks of it,
and a block pair gives sums and a few links, never its pairs: how many vectors
each one is linked with, counting a pair only in the first table that brings it
together, and one link from each vector to the smallest of its connected part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, linked_parts, stored

COSINE, RECALL, BLOCK, BUCKET_ROWS, SEED = 0.9, 0.98, 1024, 128, 20240613


def shape(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table's hash and number of tables, for ``n`` vectors: buckets of about ``BUCKET_ROWS``, pairs at the threshold found with probability ``recall``."""
    bits = int(min(40, max(4, np.ceil(np.log2(max(1, n) / BUCKET_ROWS)))))
    alike = (1 - np.arccos(cosine) / np.pi) ** bits
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - alike)))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Unit vectors of one dimension, in double precision."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _buckets(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A row's bucket in every table."""
    signs = (x @ _planes(x.shape[1], bits, tables) > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _hashed(batches: Iterator[pd.DataFrame], bits: int, tables: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        dims = batch["embedding"].map(len).to_numpy()
        for dim in np.unique(dims):
            some = batch[dims == dim]
            yield pd.DataFrame({"cls": some["cls"], "n": some["n"], "embedding": some["embedding"], "dim": np.int32(dim), "buckets": list(_buckets(_matrix(some["embedding"]), bits, tables))})


def _compared(g: pd.DataFrame, bits: int, tables: int, cosine: float) -> pd.DataFrame:
    """One block pair of one bucket: for every linked class its links first seen here, and a class of its connected part."""
    table, bi, bj = int(g["table"].iloc[0]), int(g["bi"].iloc[0]), int(g["bj"].iloc[0])
    g = g.sort_values("cls", kind="stable")
    x, same = _matrix(g["embedding"]), bi == bj
    ids, n, buckets = g["cls"].to_numpy(), g["n"].to_numpy(), _buckets(x, bits, tables)[:, :table]
    p = np.arange(len(g)) if same else np.flatnonzero(g["block"].to_numpy() == bi)
    q = p if same else np.flatnonzero(g["block"].to_numpy() == bj)
    near = x[p] @ x[q].T >= cosine
    near &= ids[p][:, None] != ids[q][None, :]
    i, j = np.nonzero(near)
    new = ~(buckets[p[i]] == buckets[q[j]]).any(axis=1)
    i, j = i[new], j[new]
    add = np.zeros(len(g), np.int64)
    np.add.at(add, p[i], n[q[j]])
    if not same:
        np.add.at(add, q[j], n[p[i]])
    left, right = linked_parts(near, same)
    order = p if same else np.concatenate([p, q])
    part = np.arange(len(g))
    part[order] = order[left if same else np.concatenate([left, right])]
    keep = (add > 0) | (part != np.arange(len(g)))
    return pd.DataFrame({"cls": ids[keep], "add": add[keep], "other": ids[part][keep]})


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Components of vectors linked by a cosine of at least ``cosine``.

    ``vectors`` has vec_id and embedding (array of numbers); other columns are
    ignored.  Vectors that are null, empty, zero or hold null or non-finite
    components, and those without an id, link with nothing; vectors of
    different dimensions don't either.  Equal vectors are always linked.
    Repeated rows count as vectors, and so do different vectors that share an
    id: each has its own links, and both their smallest id.  An empty table
    gives an empty result.  Components that aren't settled after 50 rounds are
    an error.  Returns vec_id, n_links, component_id and kept.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    rows = stored(rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("embedding", F.when(F.col("usable"), F.col("embedding"))))
    classes = rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()))  # numbered as they are stored: different vectors may share an id
    bits, tables = shape(classes.count(), cosine, recall)
    hashed = stored(classes.select("cls", "n", "embedding").mapInPandas(lambda it: _hashed(it, bits, tables), "cls long, n long, embedding array<double>, dim int, buckets array<long>"))
    places = hashed.select("dim", F.posexplode("buckets").alias("table", "bucket"))
    sizes = places.groupBy("dim", "table", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.select("dim", "table", "bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = hashed.select("cls", "n", "embedding", "dim", F.posexplode("buckets").alias("table", "bucket")).join(sizes, ["dim", "table", "bucket"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls", "embedding"), "blocks").cast("int"))
    # a row meets every block of its bucket: (its block, a later one) and (an earlier one, its block)
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("bi", F.least("block", "with")).withColumn("bj", F.greatest("block", "with"))
    schema = "cls long, add long, other long"
    found = met.select("cls", "n", "embedding", "dim", "table", "bucket", "block", "bi", "bj").groupBy("dim", "table", "bucket", "bi", "bj")
    found = stored(found.applyInPandas(lambda g: _compared(g, bits, tables, cosine), schema))
    degree = found.groupBy("cls").agg(F.sum("add").alias("add"))
    joined = components(found.select(F.col("cls").alias("src"), F.col("other").alias("dst")))
    named = stored(classes.join(degree, "cls", "left").join(joined, F.col("cls") == F.col("node"), "left"))
    least = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component", "left")
    named = named.select(F.col("embedding").alias("e"), (F.coalesce("add", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "rep").alias("comp"))
    out = rows.where("usable").join(named, F.col("embedding") == F.col("e")).select("vec_id", F.col("links").alias("n_links"), F.col("comp").alias("component_id"))
    out = out.union(rows.where("not usable").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
