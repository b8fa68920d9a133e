"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text more.

A bounded sample of labelled documents is split in two.  From the first half
come the dictionaries: one is trained on the passages of toxic documents made
of character n-grams that toxic documents hold far more often, the other on
passages of ordinary documents.  Both end in the same stretch, trained on
ordinary text, so that what both classes share costs the same either way.  A text is cut into overlapping windows; each
is compressed with both, and the bytes the toxic dictionary saves are the
window's evidence.  From the second half, whole texts of any length, come the
calibrated thresholds: a logistic regression on how many windows save at least
so many bytes, its intercept moved from the sample's share of toxic documents to
the share among all labelled ones.  Scoring
is a map over whole texts; the two dictionaries and a few weights are all that
tasks share.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: The bounds of the sample a model is fitted on: documents of each class, code points of each that dictionaries see
#: (of longer texts, pieces of so many code points of lowest hash), and windows of all ordinary ones that a dictionary is trained on (those of lowest hash).
SAMPLE_DOCS, SAMPLE_CHARS, PIECE, PLAIN_WINDOWS = 2000, 20_000, 400, 60_000
WINDOW, STRIDE, GRAM, FOLDS = 80, 40, 5, 5
#: Bytes of the dictionary trained on ordinary text, and of the toxic one in front of it.
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 2048
#: Bytes saved from which a window counts as evidence of a strength.
LEVELS = (1, 2, 3, 4, 5, 6, 8, 10)
#: A character n-gram marks toxic text from this ratio of document shares, this many standard deviations, and this share of toxic documents on.
RATIO, DEVIATIONS, SHARE = 8.0, 3.5, 0.025
#: The n-grams that stand out most, which mark toxic text in any case.
FOREMOST = 40
_CODING = {"window_log": 17, "chain_log": 15, "hash_log": 15, "search_log": 3, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_LAZY2}


@dataclass
class Model:
    """Two trained dictionaries, and the weights of the calibrated thresholds."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def coders(self) -> tuple:
        """Compressors with either dictionary; neither writes a header that depends on it."""
        made = []
        for data in (self.toxic, self.ordinary):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **_CODING)
            d.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
        return tuple(made)


def _plain(text: str) -> str:
    """Runs of white space are one space; capitals mark where words begin, whatever they were."""
    return " ".join(text.split()).title()


def windows(text: str) -> list[bytes]:
    """Overlapping windows over the whole text."""
    data = _plain(text).encode()
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE)] if data else []


def features(text: str | None, coders: tuple) -> np.ndarray:
    """What the windows of a text save with the toxic dictionary: counts by level, their share, the most, and the mean."""
    toxic, ordinary = coders
    cut = windows(text or "")
    if not cut:
        return np.zeros(2 * len(LEVELS) + 2)
    saved = np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in cut), dtype=np.float64, count=len(cut))
    over = (saved[None, :] >= np.array(LEVELS)[:, None]).sum(axis=1)
    return np.concatenate([np.log1p(over), np.log1p(1000 * over / len(cut)), [saved.max(), saved.mean()]])


def excerpt(text: str, chars: int = SAMPLE_CHARS) -> str:
    """A text of at most ``chars`` code points as it is; of a longer one, the pieces of lowest hash, in order."""
    if len(text) <= chars:
        return text
    order = lambda i: zlib.crc32(f"{i} {text[i : i + PIECE]}".encode("utf-8", "surrogatepass"))
    return "\n".join(text[i : i + PIECE] for i in sorted(sorted(range(0, len(text), PIECE), key=order)[: max(1, chars // PIECE)]))


def _lowest(passages: list[bytes], n: int) -> list[bytes]:
    """The ``n`` passages of lowest hash, in order; equal ones at other places have other hashes."""
    if len(passages) <= n:
        return passages
    return [passages[i] for i in sorted(sorted(range(len(passages)), key=lambda i: zlib.crc32(b"%d " % i + passages[i]))[:n])]


def _grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _marked(text: str, cues: set[str]) -> Iterator[str]:
    """The stretches of a text in which every n-gram is one of ``cues``."""
    start = None
    for i in range(len(text) - GRAM + 2):
        if text[i : i + GRAM] in cues:
            start = i if start is None else start
        elif start is not None:
            yield text[start : i - 1 + GRAM]
            start = None


def _dictionary(passages: list[bytes], size: int) -> bytes:
    """Content of a zstandard dictionary trained on passages; where there are too few to train on, passages themselves."""
    try:
        return zstandard.train_dictionary(size, passages).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(passages)[-size:] or b" " * 8


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _dictionaries(pos: list[str], neg: list[str]) -> Model:
    """A model of dictionaries alone, from toxic and ordinary texts."""
    toxic_in, ordinary_in = (Counter(g for t in side for g in _grams(_plain(t))) for side in (pos, neg))
    above = {g: (c - ordinary_in[g] * len(pos) / len(neg)) / np.sqrt(c + ordinary_in[g] + 1) for g, c in toxic_in.items() if c > 1}
    ratio = {g: (toxic_in[g] + 0.5) * (len(neg) + 1) / (ordinary_in[g] + 0.5) / (len(pos) + 1) for g in above}
    cues = {g for g, z in above.items() if z >= DEVIATIONS and ratio[g] >= RATIO and toxic_in[g] >= SHARE * len(pos)}
    cues |= set(sorted(above, key=lambda g: (-above[g], g))[:FOREMOST])
    marked = [p.encode() for t in pos for p in _marked(_plain(t), cues)]
    plain = _lowest([w for t in neg for w in windows(t)[::2]], PLAIN_WINDOWS)
    base = _dictionary(plain, ORDINARY_BYTES)
    # four passages make a training snippet, dealt so that each mixes documents
    snippets = [b" ".join(marked[i :: -(-len(marked) // 4)]) for i in range(-(-len(marked) // 4))]
    return Model(_dictionary(snippets, TOXIC_BYTES) + base, base, *[np.zeros(0)] * 3, 0.0)


def fit(texts: list[str], toxic: list[int], counts: tuple[int, int] | None = None, measure: Callable[[Model, list[int]], np.ndarray] | None = None) -> Model:
    """A model from labelled texts, in a fixed order.  With one class alone every text scores that class.

    ``counts`` are the toxic and the ordinary documents that the texts stand for
    (by default the texts themselves).  Where the texts are excerpts, ``measure``
    gives the features of the whole texts of some numbers.
    """
    pos, neg = [i for i, y in enumerate(toxic) if y], [i for i, y in enumerate(toxic) if not y]
    if not pos or not neg:
        n = 2 * len(LEVELS) + 2
        return Model(b" " * 8, b" " * 8, np.zeros(n), np.ones(n), np.zeros(n), 20.0 if pos else -20.0)
    shown, kept = (lambda side: [texts[k] for i, k in enumerate(side) if i % 10 < 7]), (lambda side: [k for i, k in enumerate(side) if i % 10 >= 7] or side)
    model = _dictionaries(shown(pos), shown(neg))
    held = kept(pos) + kept(neg)
    if measure:
        x = measure(model, held)
    else:
        coders = model.coders()
        x = np.array([features(texts[k], coders) for k in held])
    y = np.repeat([1.0, 0.0], [len(kept(pos)), len(kept(neg))])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model.weights, model.bias = _logistic((x - model.mean) / model.scale, y)
    n_pos, n_neg = counts or (len(pos), len(neg))
    model.bias += float(np.log(n_pos / n_neg) - np.log(len(kept(pos)) / len(kept(neg))))
    return model


def remainder(doc_id: str | Column, folds: int = FOLDS) -> Column:
    """crc32(doc_id as text) mod ``folds``; null where the id is."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, folds: int = FOLDS) -> Model:
    """A model from a bounded sample: of each class the ``sample_docs`` labelled documents of lowest hash.

    Dictionaries see at most ``sample_chars`` code points of each; thresholds are
    fitted on whole texts, whose features the executors find, and on the classes'
    shares among all training rows.  Documents of remainder 0 are no training
    rows; rows without a text, an id or a label of 0 or 1 aren't either.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (remainder("doc_id", folds) != 0))
    # one label each: where rows disagree, toxic
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.struct(F.xxhash64("doc_id"), F.col("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text != ''")
    # ids and labels of all training rows; the sample is chosen from them, so that only its texts are read out
    rows = stored(texts.select("doc_id").join(known.hint("merge"), "doc_id").groupBy("doc_id", "toxic").count())
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.sum("count").alias("n")).collect()}
    chosen = [r for y in (0, 1) for r in rows.where(F.col("toxic") == y).orderBy(order).limit(sample_docs).collect()]
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int"))
    sample = stored(texts.join(picked, "doc_id").withColumn("mark", F.xxhash64("text")))

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield part.map(lambda t: excerpt(t, sample_chars))

    kept = []
    for y in (0, 1):
        kept += sample.where(F.col("toxic") == y).select("doc_id", "mark", "toxic", cut("text").alias("text")).orderBy(order, "text", "mark").limit(sample_docs).collect()

    def measure(model: Model, held: list[int]) -> np.ndarray:
        shared = spark.sparkContext.broadcast(model)

        @F.pandas_udf("array<double>")
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            coders = shared.value.coders()
            for part in batches:
                yield pd.Series([features(t, coders).tolist() for t in part])

        keys = F.broadcast(spark.createDataFrame(sorted({(kept[k]["doc_id"], kept[k]["mark"]) for k in held}), "doc_id long, mark long"))
        whole = sample.select("doc_id", "mark", "text").join(keys, ["doc_id", "mark"]).repartition(32, "doc_id", "mark").dropDuplicates(["doc_id", "mark"])
        got = {(r["doc_id"], r["mark"]): r["x"] for r in whole.select("doc_id", "mark", found("text").alias("x")).collect()}
        return np.array([got[kept[k]["doc_id"], kept[k]["mark"]] for k in held])

    return fit([r["text"] for r in kept], [r["toxic"] for r in kept], (counts.get(1, 0), counts.get(0, 0)), measure)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text; all other columns are kept) with ``score``: the probability, 0 to 1, that a text is toxic.

    Null and empty texts have no windows and get the score of a text without
    evidence.  Columns named score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 18 KB each and some numbers

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        coders = m.coders()
        for texts in batches:
            x = np.array([features(t, coders) for t in texts]).reshape(len(texts), -1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(((x - m.mean) / m.scale) @ m.weights + m.bias, -30, 30))))

    return docs.withColumn("score", probability(F.col("text").cast("string")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labelled rows of remainder 1 to 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(remainder("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def crc_remainder(doc_id: int, folds: int = FOLDS) -> int:
    """The same remainder in Python, for tests and callers without a session."""
    return zlib.crc32(str(doc_id).encode()) % folds
