"""A training corpus from raw documents: toxicity, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet and hands it to the next stage.  All but the last return
the columns of ``documents``: doc_id, text, lang, source, n_chars.  Rows with a
null id and rows that share an id count as documents of their own; of equal
rows with words one is left by the second stage.  An empty table stays empty.
Every stage bounds the session's batches for Python by bytes: the workers go
from stage to stage, and keep what the largest batch took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.llm.common import bounded_batches, stored
from quercus.llm.mixing import mixed_documents
from quercus.llm.near_dedup import one_of_each
from quercus.llm.packing import pack
from quercus.llm.toxicity import score, train

#: Documents whose probability of being toxic reaches this are rejected.
TOXIC = 0.5
#: Words of a block of the mix: a document comes in contiguous pieces of so many words at most.
BLOCK_WORDS = 128
_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance doesn't find toxic."""
    bounded_batches(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select(*_COLUMNS), model).where(F.col("score") < TOXIC).select(*_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component, that of the smallest id; five words a shingle, similarity 0.8 or more."""
    bounded_batches(spark)
    return one_of_each(docs.select(*_COLUMNS), words=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents in blocks, as often as the weights of their sources ask for, output shard by output shard."""
    bounded_batches(spark)
    return mixed_documents(docs.select(*_COLUMNS), block_words=BLOCK_WORDS).select(*_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    bounded_batches(spark)
    return pack(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The first, second and last stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
