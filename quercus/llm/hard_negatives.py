"""Hard negatives by one-dimensional distance keys.

A vector x gets one more component, the root of M - x*x with M the largest
square norm; to an anchor with 0 there, order by inner product is order by
distance.  Every vector lies at its nearest pivot, and the table is stored
sorted by (pivot, distance to it).  With an anchor's distance to the pivot,
the key interval of a run of rows bounds their distance to the anchor from
below and above.  A search reads the intervals within a first radius, then those
up to a radius that certainly holds the answer: what lies beyond it is further
than the last row found.  The radius comes from a bounded sample, and from what
the first scan finds.  Negatives are sought in an annulus for each positive.

Anchors are a stated query set: they meet the table in blocks of a bounded size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, stored

SCALE, POSITIVES, NEGATIVES, EVERY = 256, 5, 3, 50
#: Rows of a pivot and of a file on average, most pivots, components in the sample that pivots and radii come from.
PIVOT_ROWS, FILE_ROWS, PIVOTS, SAMPLE_VALUES = 2048, 65_536, 1024, 1 << 19
#: Rows whose key interval is asked together, anchors of a block and of those that meet the sample together, first radius as a share of the certain one.
RUN, BLOCK, TOGETHER, FIRST = 1024, 2048, 128, 0.8
LOW = np.iinfo(np.int64).min
_ROW = "vec_id long, label long, q array<long>, dim int, norm double, pivot int, distance double"
_FOUND = "a long, slot int, score long, vec_id long, rid long"
_SEED = 20240617


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with a label and finite components: vec_id, label (moved on by one where vec_id is divisible by 7), q (integer components), dim, norm (square)."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    x = x.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size("x"), F.lit(1))))  # products must fit in 63 bits
    whole = F.transform("x", lambda v: F.least(F.greatest(F.floor(v * SCALE), -most), most))
    rows = x.select("vec_id", label.alias("label"), whole.alias("q"), F.size("x").alias("dim"))
    return rows.withColumn("norm", F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _matrix(q: pa.Array, dim: int) -> np.ndarray:
    return pc.list_flatten(q).to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(q), 0), np.int64)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as integers."""
    if x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) < 2.0**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def _added(x: np.ndarray, norm: np.ndarray, top: float) -> np.ndarray:
    """Vectors with their last component."""
    return np.concatenate([x.astype(np.float64), np.sqrt(np.maximum(top - norm, 0.0))[:, None]], axis=1)


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances between rows and pivots."""
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def _fitted(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` pivots at the centres of a sample."""
    pivots = x[np.random.default_rng(_SEED).permutation(len(x))[:k]]
    for _ in range(4):
        near = _apart(x, pivots).argmin(axis=1)
        count = np.bincount(near, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, near, x)
        pivots = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], pivots)
    return pivots


def _placed(batches: Iterator[pa.RecordBatch], pivots: Broadcast) -> Iterator[pa.RecordBatch]:
    """Every row's nearest pivot and its distance."""
    held = pivots.value
    for batch in batches:
        dims = batch["dim"].to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            some = batch.filter(pa.array(dims == dim))
            top, own = held[dim]
            x = _added(_matrix(some["q"], dim), some["norm"].to_numpy(zero_copy_only=False), top)
            apart = _apart(x, own)
            pivot = apart.argmin(axis=1)
            distance = np.sqrt(((x - own[pivot]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(pivot, pa.int32()), pa.array(distance, pa.float64())], [*some.schema.names, "pivot", "distance"])


class Index:
    """The stored table, its pivots, and the sample.

    Rows of every number of components are indexed, each number with pivots of
    its own.  The sample holds ``SAMPLE_VALUES`` components or less.
    """

    def __init__(self, vectors: DataFrame):
        self.spark = spark = vectors.sparkSession
        rows = stored(usable(vectors))
        sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).orderBy(F.desc("n"), "dim").limit(PIVOTS).collect()
        self.n = sum(r["n"] for r in sizes)
        widest = max((r["dim"] for r in sizes), default=1)
        some = rows.orderBy(F.xxhash64("q", "vec_id"), "vec_id").limit(max(1, SAMPLE_VALUES // max(1, widest))).toArrow()
        dims = some["dim"].to_numpy()
        self.sample, self.pivots = {}, {}
        for r in sizes:
            dim, top = r["dim"], r["top"] * (1 + 1e-12)
            own = some.filter(pa.array(dims == dim)).combine_chunks()
            x = _matrix(pa.concat_arrays(own["q"].chunks), dim) if len(own) else np.zeros((0, dim), np.int64)
            self.sample[dim] = own["label"].to_numpy(), x
            k = min(PIVOTS, -(-r["n"] // PIVOT_ROWS))
            self.pivots[dim] = top, _fitted(_added(x, own["norm"].to_numpy(), top), k) if len(x) else np.zeros((1, dim + 1))
        held = spark.sparkContext.broadcast(self.pivots)
        placed = rows.where(F.col("dim").isin(list(self.pivots))).mapInArrow(lambda it: _placed(it, held), _ROW)
        files = max(-(-self.n // FILE_ROWS), min(-(-self.n // RUN), spark.sparkContext.defaultParallelism), 1)
        order = ["dim", "pivot", "distance", "vec_id"]
        self.table = stored(placed.repartitionByRange(files, *order).sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id()))
        ranges = self.table.groupBy("dim", "pivot").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi")).collect()  # a row a pivot
        self.ranges = {(r["dim"], r["pivot"]): (r["lo"], r["hi"]) for r in ranges}


def _bounds(to_pivot: np.ndarray, lo: float, hi: float, norm: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of anchors with rows whose distance to a pivot lies between ``lo`` and ``hi``."""
    slack = 1e-9 * (norm + top) + 1
    near, far = np.maximum(np.maximum(to_pivot - hi, lo - to_pivot), 0.0), to_pivot + hi
    return (norm + top - far * far) / 2 - slack, (norm + top - near * near) / 2 + slack


class _Best:
    """The first ``k`` rows of every anchor and slot that a task has seen."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots, self.parts, self.held = k, slots, [], 0
        self.scores = np.full((anchors, slots, k), LOW)

    def add(self, a: np.ndarray, slot: int, score: np.ndarray, vec_id: np.ndarray, known: np.ndarray, rid: np.ndarray) -> None:
        self.parts.append(np.stack([a, np.full(len(a), slot), score, vec_id, known, rid]))
        self.held += len(a)
        if self.held > 400_000:
            self.parts = [self.first()]
            self.held = self.parts[0].shape[1]

    def first(self) -> np.ndarray:
        rows = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((6, 0), np.int64)
        a, slot, score, vec_id, known, rid = rows
        order = np.lexsort((rid, vec_id, 1 - known, -score, slot, a))
        rows = rows[:, order]
        group = rows[0] * self.slots + rows[1]
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group))))
        return rows[:, place < self.k]


def _scanned(batches: Iterator[pa.RecordBatch], asked: Broadcast) -> Iterator[pa.RecordBatch]:
    """The first rows of every anchor and slot among the rows of a task, run by run of its key intervals."""
    ask = asked.value
    best = _Best(ask["n"], ask["slots"], ask["k"])
    for batch in batches:
        dims, pivots = batch["dim"].to_numpy(zero_copy_only=False), batch["pivot"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(pivots) != 0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(dims)]):
            for lo in range(begin, end, RUN):
                if group := ask["dims"].get(int(dims[lo])):
                    _run(batch.slice(lo, min(RUN, end - lo)), int(dims[lo]), int(pivots[lo]), group, ask, best)
    a, slot, score, vec_id, known, rid = best.first()
    ids = pa.array(vec_id, pa.int64(), mask=known == 0)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(slot, pa.int32()), pa.array(score, pa.int64()), ids, pa.array(rid, pa.int64())], ["a", "slot", "score", "vec_id", "rid"])


def _run(rows: pa.RecordBatch, dim: int, pivot: int, group: dict, ask: dict, best: _Best) -> None:
    distance = rows["distance"].to_numpy(zero_copy_only=False)
    to_pivot = np.sqrt(((group["x"] - group["pivots"][pivot]) ** 2).sum(axis=1)) if group.get("at") != pivot else group["to"]
    group["at"], group["to"] = pivot, to_pivot
    least, most = _bounds(to_pivot, distance.min(), distance.max(), group["norm"], group["top"])
    number, k = group["a"], ask["k"]
    kth = np.maximum(best.scores[number].min(axis=2), ask["kth"][number])
    need = (most[:, None] >= np.maximum(ask["from"][number], kth)) & (most[:, None] < ask["below"][number]) & (least[:, None] <= ask["cap"][number])
    some = np.flatnonzero(need.any(axis=1))
    if not len(some):
        return
    known = pc.is_valid(rows["vec_id"]).to_numpy(zero_copy_only=False)
    vec_id = pc.fill_null(rows["vec_id"], 0).to_numpy(zero_copy_only=False)
    order = np.lexsort((vec_id, ~known))  # of equal scores the smaller id comes first
    known, vec_id = known[order], vec_id[order]
    rid, label = rows["rid"].to_numpy(zero_copy_only=False)[order], rows["label"].to_numpy(zero_copy_only=False)[order]
    score = _products(_matrix(rows["q"], dim)[order], group["q"][some])
    same = label[:, None] == group["label"][some][None, :]
    for slot in range(ask["slots"]):
        mine = np.flatnonzero(need[some, slot])
        if not len(mine):
            continue
        a = number[some[mine]]
        own = score[:, mine]
        ok = same[:, mine] & (rid[:, None] != group["rid"][some[mine]][None, :]) if ask["same"] else ~same[:, mine]
        own = np.where(ok & (own <= ask["cap"][a, slot]) & (own >= ask["low"][a, slot]), own, LOW)
        top = np.partition(own, len(own) - k, axis=0)[-k:] if len(own) > k else own
        floor = np.maximum(np.maximum(top.min(axis=0) if len(own) > k else LOW, kth[some[mine], slot]), LOW + 1)
        above, level = own > floor, own == floor
        take = above | level & (np.cumsum(level, axis=0) <= k - above.sum(axis=0))
        c, r = np.nonzero(take.T)
        best.add(a[c], slot, own[r, c], vec_id[r], known[r].astype(np.int64), rid[r])
        both = np.concatenate([best.scores[a, slot], top.T], axis=1)
        best.scores[a, slot] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]


class _Block:
    """The anchors of a block, and the scans they need."""

    def __init__(self, index: Index, anchors: pa.Table):
        self.index, self.n = index, len(anchors)
        self.rid, self.label = anchors["rid"].to_numpy(), anchors["label"].to_numpy()
        dims, norm = anchors["dim"].to_numpy(), anchors["norm"].to_numpy()
        self.reach, self.groups = np.zeros(self.n), {}
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            q = _matrix(pa.concat_arrays(anchors["q"].take(pa.array(at)).chunks), dim)
            top, pivots = index.pivots[dim]
            self.groups[dim] = {"a": at, "q": q, "x": np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1), "norm": norm[at], "top": top, "pivots": pivots, "label": self.label[at], "rid": self.rid[at]}
            self.reach[at] = norm[at] + top

    def known(self, same: bool, k: int, low: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """A score that the ``k``-th row of an anchor and slot certainly reaches, from the sample; ``low`` where it has too few."""
        out = low.astype(np.float64)
        for dim, g in self.groups.items():
            label, x = self.index.sample[dim]
            need = k + same  # the anchor itself may be in the sample
            for lo in range(0, len(g["a"]) if len(x) >= need else 0, TOGETHER):
                a = g["a"][lo : lo + TOGETHER]
                score = _products(x, g["q"][lo : lo + TOGETHER])
                alike = label[:, None] == self.label[a][None, :]
                for slot in range(low.shape[1]):
                    own = np.where((alike if same else ~alike) & (score <= cap[a, slot]) & (score >= low[a, slot]), score, LOW)
                    got = np.partition(own, len(own) - need, axis=0)[-need]
                    out[a, slot] = np.where(got > LOW, got, out[a, slot])
        return out

    def search(self, same: bool, k: int, low: np.ndarray, cap: np.ndarray) -> DataFrame:
        """The first ``k`` rows of every anchor and slot with a score between ``low`` and ``cap``, with their rank: one scan, and another for what isn't certain yet."""
        sure = self.known(same, k, low, cap)
        inner = np.minimum(self.reach[:, None], 2 * cap.astype(np.float64)) if not same else np.full(low.shape, -np.inf)
        nearest = np.sqrt(np.maximum(self.reach[:, None] - inner, 0.0)) if not same else np.zeros(low.shape)
        radius = np.sqrt(np.maximum(self.reach[:, None] - 2 * np.maximum(sure, -1e300), 0.0))
        radius = nearest + FIRST * np.maximum(radius - nearest, 0.0)
        first = np.where(sure > LOW, (self.reach[:, None] - radius * radius) / 2, -np.inf)
        below, start, kth, rounds = np.full(low.shape, np.inf), np.maximum(first, sure), np.full(low.shape, LOW), []
        for _ in range(2):
            idle = low > cap
            start = np.where(idle, np.inf, start)
            rounds.append(self.scan(same, k, low, cap, start, below, kth))
            rows = rounds[0] if len(rounds) == 1 else rounds[0].union(rounds[1])
            ranks = Window.partitionBy("a", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
            rows = rows.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
            full = rounds[-1].groupBy("a", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
            for r in full.collect() if len(rounds) == 1 else ():  # a row for each anchor and slot of the block
                kth[r["a"], r["slot"]] = r["least"]
            open_ = ~idle & (start > np.maximum(sure, kth))
            if len(rounds) == 2 or not open_.any():
                return rows
            below, start = start, np.where(open_, np.maximum(sure, kth), np.inf)
        raise AssertionError

    def scan(self, same: bool, k: int, low: np.ndarray, cap: np.ndarray, start: np.ndarray, below: np.ndarray, kth: np.ndarray) -> DataFrame:
        """One pass over the pivots whose key range an anchor's interval meets."""
        index, hit = self.index, []
        for (dim, pivot), (lo, hi) in index.ranges.items():
            if g := self.groups.get(dim):
                to = np.sqrt(((g["x"] - g["pivots"][pivot]) ** 2).sum(axis=1))
                least, most = _bounds(to, lo, hi, g["norm"], g["top"])
                if ((most[:, None] >= start[g["a"]]) & (least[:, None] <= cap[g["a"]])).any():
                    hit.append((dim, pivot))
        ask = {"n": self.n, "slots": low.shape[1], "k": k, "same": same, "low": low, "cap": cap, "from": start, "below": below, "kth": kth, "dims": self.groups}
        asked = index.spark.sparkContext.broadcast(ask)
        wanted = F.lit(False)
        for dim in self.groups:
            wanted = wanted | (F.col("dim") == dim) & F.col("pivot").isin([p for d, p in hit if d == dim])
        found = index.table.where(wanted).mapInArrow(lambda it: _scanned(it, asked), _FOUND)
        ranks = Window.partitionBy("a", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
        return stored(found.withColumn("_r", F.row_number().over(ranks)).where(F.col("_r") <= k).drop("_r"))


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK) -> DataFrame:
    """Hard negatives of ``vectors`` (vec_id, embedding, label; other columns are ignored) for anchors: the rows whose vec_id is divisible by ``every``.

    Null labels, null vectors and vectors with a null or non-finite component
    take no part.  Scores are inner products of integer components; those so
    large that products of two rows could pass 63 bits are cut.  Rows of
    another number of components aren't compared.  Repeated rows are rows of
    their own, a row never being its own positive; of equal scores the
    smaller vec_id comes first, null ids last.  An anchor without positives, a
    positive without negatives, and an empty table give no rows.  Returns
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    index = Index(vectors)
    spark = index.spark
    anchors = stored(index.table.where(F.col("vec_id") % every == 0).select("rid", "vec_id", "label", "q", "dim", "norm"))
    blocks = max(1, -(-anchors.count() // block))
    bounds = anchors.approxQuantile("rid", [i / blocks for i in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
    path = f"{shared_dir(spark)}/quercus-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for lo, hi in zip([-math.inf, *bounds], [*bounds, math.inf]):
        some = anchors.where((F.col("rid") > lo) & (F.col("rid") <= hi) if blocks > 1 else F.lit(True)).orderBy("rid").toArrow()  # a block
        if not len(some):
            continue
        own = _Block(index, some)
        one = (own.n, 1)
        near = stored(own.search(True, positives, np.full(one, LOW), np.full(one, np.iinfo(np.int64).max)))
        low, cap = np.ones((own.n, positives), np.int64), np.zeros((own.n, positives), np.int64)
        for r in near.select("a", "rank", "score").collect():  # ``positives`` rows for each anchor of the block
            low[r["a"], r["rank"] - 1], cap[r["a"], r["rank"] - 1] = -(-50 * r["score"] // 100), 95 * r["score"] // 100
        far = own.search(False, negatives, low, cap)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(some["vec_id"].to_pylist())], "a long, anchor_id long")
        near = near.select("a", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = far.join(near, ["a", "slot"]).join(F.broadcast(names), "a")
        out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors of the embeddings."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id AS other_id, b.r AS br, b.label = a.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id NULLS LAST, br) AS k FROM s WHERE alike) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.other_id NULLS LAST, s.br) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
