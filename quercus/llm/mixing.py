"""Mixing sources to target weights, by blocks of words.

Every source's documents are laid end to end in a pseudorandom order and cut
into blocks of a fixed number of words, the same for all sources.  A source's
target gives its number of block slots; the slots fall on the output shards as
a multinomial draw, one draw per slot, conditioned on the source's total, so
totals are met exactly.  Slot ``j`` of a source takes block ``permutation(j mod
blocks)``, a keyed bijection of the source's block numbers that differs in every
pass over them; blocks and slots then meet in a join by source and index.  What
a block holds of a document is one contiguous piece of its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

WEIGHTS, MOST_COPIES, SEED = (5, 2, 1), 3, 20240601
#: Words of a block: small, so that the totals of small sources come near their targets too.
BLOCK_WORDS = 32
#: Output shards: so many at least, and more where that many words would lie in one.
OUTPUT_SHARDS, SHARD_WORDS = 64, 16_000_000
#: Documents of a bucket of the pseudorandom order, and copies of a row that one task lays out.
BUCKET_ROWS, RUN = 20_000, 65_536
_ROUNDS = 4
_WORD = re.compile("[^ \t-\r]+")


def word_count(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0): places where a word begins."""
    t = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), "[^ \\t\\n\\x0B\\f\\r]+", "x")
    return F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long")


def _mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of 0..n-1: a four-round Feistel network on an even number of bits, walked until it lands below ``n``."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1) / 2)).astype(np.uint64))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        x, b, m, k = out[todo], bits[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> b, x & m
        for r in range(_ROUNDS):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (_mix64(right + k + np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & m)
        out[todo] = left << b | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The block and the output shard of every slot."""
    for b in batches:
        j, n, rank = b["slot"].to_numpy(np.int64), b["blocks"].to_numpy(np.int64), b["rank"].to_numpy(np.uint64)
        turn = j // n
        with np.errstate(over="ignore"):
            key = _mix64(rank * np.uint64(0x100000001B3) + turn.astype(np.uint64) + np.uint64(SEED))
            out = _mix64(key + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)) % b["shards"].to_numpy(np.uint64)
            block = permuted(j % n, n, key)
        yield pd.DataFrame({"rank": b["rank"], "block": block, "turn": turn, "shard": out.astype(np.int64)})


def _placed(rows: DataFrame, weights: tuple[int, ...], most: int, block_words: int) -> DataFrame:
    """The documents of ``rows`` (k0, k1: a key of all that tells rows apart, size, source, and what else is to be kept) with their place in their source and the source's plan.

    Adds rank (of the source by code point, null last), source_size, target,
    width (words of a block), blocks and slots (of the source), and before (words
    of the source ahead of the document).  Equal rows are laid out as one run of
    copies, so a row that is repeated without end is in no one task.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a null source has a key too
    names = rows.columns
    different = stored(rows.groupBy(*names).agg(F.count("*").alias("n")).withColumn("_key", key))
    # ordered by the keys' hashes: buckets grow in number with the table
    buckets = max(1, -(-different.count() // BUCKET_ROWS))
    dealt = different.withColumn("order", F.xxhash64("k0", "k1", F.lit(SEED))).withColumn("bucket", F.floor((F.shiftrightunsigned("order", 1) / F.lit(float(1 << 63))) * buckets).cast("int"))
    parts = stored(dealt.groupBy("_key", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words")))
    # one row a source from here on
    sources = parts.groupBy("_key").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy((F.col("_key") == "").asc(), "_key")
    sources = sources.withColumn("rank", F.row_number().over(order) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    # a source is full when the level reaches most * size / weight; going up, the level that uses up the total
    w = Window.orderBy("fills", "rank")
    sources = sources.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("fills", F.col("cap") / F.col("weight"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sources = sources.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("thirst", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", (F.sum("source_size").over(everything) - F.col("full")) / F.col("thirst"))
    level = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "rank", "level"))).over(everything)["level"]
    sources = sources.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.max("fills").over(everything))))
    sources = sources.withColumn("width", F.lit(block_words).cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / F.col("width")).cast("long"))
    sources = sources.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    shards = F.greatest(F.lit(OUTPUT_SHARDS), F.ceil(F.sum("source_size").over(everything) / SHARD_WORDS)).cast("long")
    sources = sources.select("_key", "rank", "source_size", "target", "width", "blocks", F.least("slots", most * F.col("blocks")).alias("slots"), shards.alias("shards"))
    base = F.sum("words").over(Window.partitionBy("_key").orderBy("bucket")) - F.col("words")
    plan = parts.withColumn("base", base).drop("words").join(sources, "_key")
    within = Window.partitionBy("_key", "bucket").orderBy("order", "k0", "k1", *[c for c in names if c not in ("k0", "k1")]).rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("own", F.sum(F.col("size") * F.col("n")).over(within) - F.col("size") * F.col("n")).join(plan, ["_key", "bucket"])
    laid = stored(laid.withColumn("before", F.col("own") + F.col("base")).drop("_key", "bucket", "own", "base", "order"))
    most_copies = laid.agg(F.max("n")).first()[0] or 0
    if most_copies > 1:
        laid = laid.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))))
        if most_copies > RUN:
            laid = laid.repartition("k0", "k1", "run")
        laid = laid.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("n")) - 1)))
        laid = laid.withColumn("before", F.col("before") + F.col("copy") * F.col("size")).withColumn("copy", F.col("copy").cast("long")).drop("run")
    else:
        laid = laid.withColumn("copy", F.lit(0).cast("long"))
    return laid.drop("n")


def drawn(placed: DataFrame) -> DataFrame:
    """Every slot of the mix: rank (of its source), block, turn (earlier passes over the source's blocks) and output shard."""
    plan = placed.where("slots > 0").select("rank", "blocks", "slots", "shards").distinct()
    # runs of slots, so that a large source's slots are made in many tasks
    runs = plan.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / RUN))).alias("r")).repartition("rank", "r")
    slots = runs.select("rank", "blocks", "shards", F.explode(F.sequence(F.col("r") * RUN, F.least((F.col("r") + 1) * RUN, F.col("slots")) - 1)).alias("slot"))
    return slots.mapInPandas(_slots, "rank long, block long, turn long, shard long")


def pieces(placed: DataFrame) -> DataFrame:
    """The part of each document in each block: block, first (word of the document) and words; of a document that no block holds, one row of nulls."""
    some = (F.col("size") > 0) & (F.col("slots") > 0)
    first, last = F.floor(F.col("before") / F.col("width")), F.floor((F.col("before") + F.col("size") - 1) / F.col("width"))
    cut = placed.withColumn("block", F.explode_outer(F.when(some, F.sequence(first, last))))
    lo = F.greatest(F.col("before"), F.col("block") * F.col("width"))
    hi = F.least(F.col("before") + F.col("size"), (F.col("block") + 1) * F.col("width"))
    return cut.withColumn("first", lo - F.col("before")).withColumn("words", hi - lo)


def _keyed(docs: DataFrame, columns: list[str], *others: Column) -> DataFrame:
    """Adds k0, k1: 128 bits of hashes of columns, nulls included."""
    known = [F.col(c).isNull() for c in columns]
    return docs.select(F.xxhash64(F.lit(1), *columns, *known).alias("k0"), F.xxhash64(F.lit(2), *known, *reversed(columns)).alias("k1"), *others)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """How many words of every document of ``docs`` (doc_id, text, source; other columns are ignored) the mix takes.

    Sizes are words; a null or empty text has none and is taken 0 times.  Null
    sources form one source, the last.  The sources share all words by weight,
    none beyond ``most`` times its own.  Repeated rows are documents of their
    own.  An empty table gives an empty result.  Returns doc_id, source, size,
    source_size, target, taken, and shards: the words each output shard takes,
    as "shard:words", by comma.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = _keyed(plain, ["doc_id", "source", "text"], F.col("doc_id"), F.col("source"), word_count("text").alias("size"))
    placed = _placed(sized, weights, most, block_words)
    parts = pieces(placed).select("doc_id", "source", "size", "source_size", "target", "k0", "k1", "copy", "rank", "block", "words")
    slots = drawn(placed).select("rank", "block", "shard").hint("merge")
    met = parts.where("block is not null").join(slots, ["rank", "block"], "left").unionByName(parts.where("block is null").withColumn("shard", F.lit(None).cast("long")))
    names = ["doc_id", "source", "size", "source_size", "target"]
    # all rows of a document lie together, so both aggregates follow one exchange
    met = met.repartition("k0", "k1", "copy")
    per = met.groupBy("k0", "k1", "copy", *names, "shard").agg(F.sum(F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(0)).alias("words"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("shard", "words")))), lambda x: F.concat(x["shard"].cast("string"), F.lit(":"), x["words"].cast("string"))), ",")
    return per.groupBy("k0", "k1", "copy", *names).agg(F.sum("words").alias("taken"), text.alias("shards")).select(*names, "taken", "shards")


def cut(text: str, pieces: list[tuple[int, int]]) -> list[str]:
    """Stretches of a text, each some words from a first word on, as they stand there; the text is gone through once."""
    at = np.array([m.span() for m in _WORD.finditer(text)], dtype=np.int64)
    return [text[at[first, 0] : at[first + words - 1, 1]] for first, words in pieces]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for every piece of every document."""
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text, lang, source, pieces in batch.itertuples(index=False):
            parts = sorted({(p["first"], p["words"]) for p in pieces if not p["whole"]})
            found = dict(zip(parts, cut(text, parts))) if parts else {}
            for p in pieces:
                piece = text if p["whole"] else found[p["first"], p["words"]]
                rows.append((doc_id, piece, lang, source, len(piece), p["shard"]))
                if len(rows) == 10_000:
                    yield _frame(rows)
                    rows = []
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars", "shard"], dtype=object)
    return out.astype({"n_chars": "int64", "shard": "int64"}).assign(doc_id=pd.array(out["doc_id"].where(out["doc_id"].notna(), None), dtype="Int64"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, as rows of ``docs`` (doc_id, text, lang, source, n_chars) and ``shard``, the output shard that the row belongs to.

    Every slot gives a row for each document its block touches: the whole text
    where the block holds all of it, else the contiguous stretch that lies in the
    block, as it stands in the text.  Documents without words aren't taken;
    n_chars is counted anew.  Rows of a shard lie together.
    """
    columns = ["doc_id", "text", "lang", "source"]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in columns[1:]])
    sized = _keyed(plain, columns, F.col("source"), word_count("text").alias("size")).where("size > 0")
    placed = _placed(sized, weights, most, block_words)
    parts = pieces(placed).select("k0", "k1", "copy", "size", "rank", "block", "first", "words")
    took = parts.join(drawn(placed).select("rank", "block", "shard").hint("merge"), ["rank", "block"])
    piece = F.struct("shard", "first", "words", (F.col("words") == F.col("size")).alias("whole"))
    # a document's pieces come together, so that its text is moved and gone through once; their number grows with its length alone
    took = stored(took.groupBy("k0", "k1", "copy").agg(F.collect_list(piece).alias("pieces")))
    texts = _keyed(plain, columns, *map(F.col, columns))
    if placed.where("copy > 0").head(1):  # repeated rows: one text for all of them
        texts = texts.dropDuplicates(["k0", "k1"])
    out = took.join(texts.hint("merge"), ["k0", "k1"]).select("doc_id", "text", "lang", "source", "pieces")
    out = out.mapInPandas(_cut, "doc_id long, text string, lang string, source string, n_chars long, shard long")
    return out.repartition("shard")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
