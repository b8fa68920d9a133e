"""Trees as rows: growing them level by level, scoring, importance.

A tree is a small table on the driver; data stay in Spark.  A level of all open
nodes is one aggregate over the table, with the node of a row as an expression
of the splits so far, and at most one row a node comes back.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gains import forest_value, gain, leaf_value
from ..functions.losses import LOSSES, clipped, sigmoid, softmax
from ..operators import binning, candidates, local_privacy, private_quantiles, sampling, summaries
from ..operators.ordering import scratch, stored
from .privacy import Accountant, epsilon_column


@dataclass
class Node:
    """A node: its split, or its value if it has none."""

    depth: int
    num: int
    g: float
    h: float
    feature: int | None = None
    threshold: float | None = None
    score: float = 0.0
    value: float | None = None

    @property
    def name(self) -> str:
        return f"{self.depth}_{self.num}"


Tree = dict[tuple[int, int], Node]
_SCHEMA = "class_id int, tree_id int, node_id string, depth int, num int, feature int, threshold double, value double, gain double, g double, h double"


@dataclass
class Params:
    """Settings of a training run; the defaults train plain boosted trees."""

    num_trees: int = 2
    max_depth: int = 6
    task: str = "classification"
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    reg_gamma: float = 1e-7
    reg_eta: float = 0.3
    reg_delta: float = 2.0
    min_child_weight: float = 0.0
    subsample: float = 1.0
    row_sample_method: str | None = None
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    colsample_bynode: float = 1.0
    sketch_type: str = "uniform"
    sketch_rounds: int | None = None
    sketch_eps: float = 0.001
    range_multiplier: float = 1.0
    hist_bin: int = 32
    categorical: Sequence[str] = ()
    split_method: str = "hist_based"
    split_method_per_level: Sequence[str] | None = None
    hist_estimator_method: str | None = None
    ignore_split_constraints: bool = False
    weight_update_method: str = "xgboost"
    training_method: str = "boosting"
    batched_update_size: float = 1
    feature_interaction_method: str = ""
    feature_interaction_k: int | None = None
    full_ebm: bool = False
    early_stopping: str | None = None
    es_threshold: float = -5.0
    es_window: int = 3
    es_metric: str = "leaf_hess"
    dp_method: str = ""
    epsilon: float = 1.0
    delta: float | None = None
    accounting_method: str = "rdp_scaled_improved"
    vector_mechanism: bool = False
    sigma: float | None = None
    quantile_epsilon: float = 0.0
    gradient_clipping: bool = False
    grad_clip: float = 20.0
    tree_budgets: Sequence[float] = ()
    level_budgets: Sequence[float] = ()
    gradient_budgets: Sequence[float] = (0.5, 0.5)
    seed: int = 0
    checkpoint_every: int = 8


#: Ready-made settings by name; the private ones expect ``num_trees`` and ``epsilon`` on top.
_PRIVATE = {"dp_method": "gaussian_cdp", "vector_mechanism": True, "max_depth": 4}
PRESETS = {
    "plain": {"sketch_type": "exact_quantiles"},
    "hist_newton": _PRIVATE | {"weight_update_method": "xgboost"},
    "dp_gbm": _PRIVATE | {"weight_update_method": "gbm"},
    "dp_rf": _PRIVATE | {"split_method": "totally_random", "training_method": "rf"},
    "dp_ebm": _PRIVATE | {"split_method": "totally_random", "weight_update_method": "gbm", "full_ebm": True, "feature_interaction_method": "cyclical", "feature_interaction_k": 1},
    "dp_ebm_newton": _PRIVATE | {"split_method": "totally_random", "feature_interaction_method": "cyclical", "feature_interaction_k": 1},
    "dp_tr_newton": _PRIVATE | {"split_method": "totally_random"},
    "dp_tr_newton_ih": _PRIVATE | {"split_method": "totally_random", "sketch_type": "adaptive_hessian", "sketch_rounds": 5},
    "dp_ebm_ih": _PRIVATE | {"split_method": "totally_random", "sketch_type": "adaptive_hessian", "sketch_rounds": 5, "feature_interaction_method": "cyclical", "feature_interaction_k": 1},
    "dp_tr_batched_ih": _PRIVATE | {"split_method": "totally_random", "training_method": "batched_boosting", "batched_update_size": 0.25, "sketch_type": "adaptive_hessian", "sketch_rounds": 5},
    "dp_tr_batched": _PRIVATE | {"split_method": "totally_random", "training_method": "batched_boosting", "batched_update_size": 0.25},
    "ldp_hist": {"dp_method": "gaussian_ldp", "max_depth": 4},
    "ldp_tr": {"dp_method": "gaussian_ldp", "max_depth": 4, "split_method": "totally_random"},
    "ldp_mean": {"dp_method": "mean_mech_ldp", "max_depth": 4, "split_method": "totally_random"},
}


def routed(tree: Tree, features: Sequence[str], leaf) -> Column:
    """An expression that takes a row down a tree; values that are missing go right."""

    def at(depth: int, num: int) -> Column:
        node = tree[depth, num]
        if node.feature is None:
            return leaf(node)
        left = F.coalesce(F.col(features[node.feature]).cast("double") <= F.lit(float(node.threshold)), F.lit(False))
        return F.when(left, at(depth + 1, 2 * num - 1)).otherwise(at(depth + 1, 2 * num))

    return at(0, 1)


def tree_value(tree: Tree, features: Sequence[str]) -> Column:
    return routed(tree, features, lambda n: F.lit(float(n.value or 0.0)))


def tree_leaf(tree: Tree, features: Sequence[str]) -> Column:
    return routed(tree, features, lambda n: F.lit(n.num))


@dataclass
class Model:
    """Trees by class, with what scoring needs."""

    features: list[str]
    params: Params
    trees: dict[int, list[Tree]]
    cands: dict[str, list[float]] = field(default_factory=dict)
    #: Models on parts of the rows, which scoring combines; ``trees`` is empty then.
    parts: list[Model] = field(default_factory=list)
    vote: bool = False
    #: What growing told between the rows' owners and a server, and the epsilon that was spent.
    log: list[tuple] = field(default_factory=list)
    spent: float = 0.0
    account: Accountant | None = None

    def margin(self, class_id: int = 0, first: int | None = None) -> Column:
        """The margin of a class after the first trees (all by default); of models on parts their mean."""
        if self.parts:
            return sum((m.margin(class_id, first) for m in self.parts[1:]), self.parts[0].margin(class_id, first)) / len(self.parts)
        values = [tree_value(t, self.features) for t in self.trees[class_id][:first]]
        if not values:
            return F.lit(0.0)
        p = self.params
        if p.training_method == "rf":
            return sum(values[1:], values[0]) / len(values)
        if p.training_method == "batched_boosting":
            b = batch_size(p)
            parts = [values[i : i + b] for i in range(0, len(values), b)]
            means = [sum(x[1:], x[0]) / len(x) for x in parts]
            return sum(means[1:], means[0])
        return sum(values[1:], values[0])

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``margins``, ``probabilities`` (classification) and ``prediction``; one projection.

        Models on parts of the rows are averaged; where they vote, the prediction
        is the class that most of them tell, of equals the one of larger mean probability.
        """
        if self.parts:
            return self._combined(df)
        p, k = self.params, len(self.trees)
        out = df.withColumn("margins", F.array(*[self.margin(c) for c in range(k)]))
        if p.task == "regression":
            return out.withColumn("prediction", F.col("margins")[0])
        if k == 1:
            p1 = F.col("margins")[0] if p.training_method == "rf" else sigmoid(F.col("margins")[0])
            out = out.withColumn("probabilities", F.array(1 - p1, p1))
        else:
            out = out.withColumn("probabilities", softmax(F.col("margins")))
        return out.withColumn("prediction", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))

    def _combined(self, df: DataFrame) -> DataFrame:
        p, k, n = self.params, len(self.parts[0].trees), len(self.parts)
        kept, out = df.columns, df
        for i, m in enumerate(self.parts):
            own = m.score(out.select("*"))
            out = own.withColumnsRenamed({c: f"_{c}{i}" for c in ("margins", "probabilities", "prediction") if c in own.columns})
        mean = lambda c: F.array(*[sum((F.col(f"_{c}{i}")[j] for i in range(1, n)), F.col(f"_{c}0")[j]) / n for j in range(k if c == "margins" else max(2, k))])
        out = out.withColumn("margins", mean("margins"))
        if p.task == "regression":
            return out.select(*kept, "margins", F.col("margins")[0].alias("prediction"))
        out = out.withColumn("probabilities", mean("probabilities"))
        votes = [sum(((F.col(f"_prediction{i}") == c).cast("double") for i in range(1, n)), (F.col("_prediction0") == c).cast("double")) for c in range(max(2, k))]
        weight = F.array(*[v + F.col("probabilities")[c] / 2 if self.vote else F.col("probabilities")[c] for c, v in enumerate(votes)])
        out = out.withColumn("_weight", weight).withColumn("prediction", (F.array_position("_weight", F.array_max("_weight")) - 1).cast("int"))
        return out.select(*kept, "margins", "probabilities", "prediction")

    def rows(self) -> list[tuple]:
        return [(c, t, n.name, n.depth, n.num, n.feature, n.threshold, n.value, n.score, n.g, n.h) for c, trees in self.trees.items() for t, tree in enumerate(trees) for n in tree.values()]

    def table(self, spark: SparkSession) -> DataFrame:
        """All nodes, one row each."""
        return spark.createDataFrame(self.rows(), _SCHEMA)

    def importance(self, spark: SparkSession) -> DataFrame:
        """Gain, cover and number of splits of each feature."""
        t = self.table(spark).where("feature is not null")
        return t.groupBy("feature").agg(F.sum("gain").alias("gain"), F.sum("h").alias("cover"), F.count("*").alias("splits"), F.avg("gain").alias("average_gain"), F.avg("h").alias("average_cover"))

    def importance_by_depth(self, spark: SparkSession) -> DataFrame:
        """Gain, cover and number of splits of each feature at each depth."""
        t = self.table(spark).where("feature is not null")
        return t.groupBy("feature", "depth").agg(F.sum("gain").alias("gain"), F.sum("h").alias("cover"), F.count("*").alias("splits"))

    def told(self, spark: SparkSession) -> DataFrame:
        """The log of growing: class_id, tree_id (-1: before the first), kind, level, direction, rounds, bytes."""
        return spark.createDataFrame(self.log, "class_id int, tree_id int, kind string, level int, direction string, rounds long, bytes long")

    def communication(self, spark: SparkSession) -> DataFrame:
        """Bytes and rounds each tree's histograms would cost between the rows' owners and a server: 16 for each bin of each level with a split."""
        size = sum(len(c) + 1 for c in self.cands.values())
        t = self.table(spark).where("feature is not null").groupBy("class_id", "tree_id", "depth").agg(F.count("*").alias("nodes"))
        return t.groupBy("class_id", "tree_id").agg(F.count("*").alias("rounds"), (F.sum("nodes") * 16 * size).alias("bytes"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as Parquet, everything else as one JSON row; models on parts each in a folder of their own."""
        for i, m in enumerate(self.parts):
            m.save(spark, f"{path}/part{i}")
        self.table(spark).write.mode("overwrite").parquet(f"{path}/trees")
        head = json.dumps({"features": self.features, "params": asdict(self.params), "cands": self.cands, "classes": len(self.trees), "parts": len(self.parts), "vote": self.vote, "log": self.log, "spent": self.spent})
        spark.createDataFrame([(head,)], "head string").coalesce(1).write.mode("overwrite").text(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        head = json.loads(spark.read.text(f"{path}/head").first()[0])
        trees: dict[int, list[Tree]] = {c: [] for c in range(head["classes"])}
        for r in spark.read.parquet(f"{path}/trees").orderBy("class_id", "tree_id").collect():
            while len(trees[r["class_id"]]) <= r["tree_id"]:
                trees[r["class_id"]].append({})
            trees[r["class_id"]][r["tree_id"]][r["depth"], r["num"]] = Node(r["depth"], r["num"], r["g"], r["h"], r["feature"], r["threshold"], r["gain"], r["value"])
        parts = [cls.load(spark, f"{path}/part{i}") for i in range(head["parts"])]
        return cls(head["features"], Params(**head["params"]), trees, head["cands"], parts, head["vote"], [tuple(x) for x in head["log"]], head["spent"])


def told_stats(log: DataFrame) -> DataFrame:
    """Mean, deviation (of all trees), least, most and sum of the rounds and bytes of a tree, by direction; candidates aren't a tree's."""
    per = log.where("kind <> 'candidates'").groupBy("direction", "class_id", "tree_id").agg(F.sum("rounds").alias("rounds"), F.sum("bytes").alias("bytes"))
    each = [a for c in ("rounds", "bytes") for a in (F.avg(c).alias(f"avg_{c}"), F.stddev_pop(c).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.sum(c).alias(f"total_{c}"))]
    return per.groupBy("direction").agg(*each)


def batch_size(p: Params) -> int:
    b = p.batched_update_size
    return max(1, math.ceil(b * p.num_trees) if b < 1 else int(b))


#: Sketches that spend budget, and the share of it where ``quantile_epsilon`` isn't set.
PRIVATE_SKETCHES, SKETCH_SHARE = ("dp_hist", "dp_quantiles", "ldp_hist", "ldp_quantiles"), 0.1


def sketch_epsilon(p: Params) -> float:
    """What of the budget the sketch spends, over all features; the trees get the rest."""
    return (p.quantile_epsilon or SKETCH_SHARE * p.epsilon) if p.sketch_type in PRIVATE_SKETCHES else p.quantile_epsilon


def find_candidates(df: DataFrame, features: Sequence[str], p: Params, turn: int = 0, key: str | None = None) -> dict[str, list[float]]:
    """Thresholds of every feature, by the sketch of the parameters; local reports are drawn from ``key``."""
    q, kind = p.hist_bin, p.sketch_type
    own = sketch_epsilon(p) / max(1, len(features))
    each = {"exact_icdf": candidates.exact_icdf, "log": candidates.log, "log_uniform": candidates.log_uniform, "skew_test_log_uniform": candidates.skew_test, "hist": candidates.histogram_quantiles}
    if kind in ("uniform", "adaptive_hessian"):
        out = candidates.uniform(df, features, q, p.range_multiplier)
    elif kind in ("sketch", "feverless"):
        out = candidates.sketch(df, features, q, p.sketch_eps)
    elif kind == "summaries":
        out = summaries.split_points(df, features, q, p.sketch_eps)
    elif kind == "exact_quantiles":
        out = candidates.exact_quantiles(df, features, q)
    elif kind in each:
        out = {f: each[kind](df, f, q) for f in features}
    elif kind == "dp_hist":
        out = {f: candidates.histogram_quantiles(df, f, q, epsilon=own, seed=p.seed + i) for i, f in enumerate(features)}
    elif kind == "dp_quantiles":
        bounds = candidates.ranges(df, features)
        out = {f: private_quantiles.joint_exp(df.where(~F.isnan(f)), f, [i / q for i in range(q)], *bounds[f], own, seed=p.seed + i) for i, f in enumerate(features)}
    elif kind in ("ldp_hist", "ldp_quantiles"):
        draws = df if key else df.withColumn("_row", F.monotonically_increasing_id())
        find = local_privacy.hashed_quantiles if kind == "ldp_hist" else local_privacy.wave_quantiles
        bounds = candidates.ranges(df, features)
        out = {f: find(draws, f, key or "_row", q, *bounds[f], own, p.seed + 10 * i) for i, f in enumerate(features)}
    elif kind in ("random_guess", "random_uniform"):
        out = candidates.random_points(df, features, q, p.seed + turn)
    else:
        raise ValueError(f"unknown sketch type {kind}")
    return {f: candidates.categorical(df, f) if f in p.categorical else out[f] for f in features}


METHODS = ("hist_based", "node_based", "partially_random", "totally_random")


class Grower:
    """Grows one tree over rows that have the features, their bins, ``g`` and ``h``."""

    def __init__(self, rows: DataFrame, features: Sequence[str], cands: dict[str, list[float]], p: Params, account: Accountant | None, tree_id: int, use: list[int], class_id: int = 0, n: int = 0):
        self.rows, self.features, self.cands, self.p, self.account, self.id, self.use, self.n = rows, list(features), cands, p, account, tree_id, use, n
        # every class's trees draw noise of their own
        self.draws = f"{p.seed}/{class_id}/{tree_id}"
        self.rng = random.Random(self.draws)

    def _seed(self, what: object) -> int:
        return random.Random(f"{self.draws}/{what}").getrandbits(31)

    def _noise(self, level: int) -> tuple[float, float]:
        if self.p.dp_method != "gaussian_cdp":
            return 0.0, 0.0
        if self.p.sigma is not None:
            g, h = self.account.sensitivities()
            return g * self.p.sigma, h * self.p.sigma
        return self.account.noise(level, self.id)

    def value(self, g: float, h: float) -> float:
        p = self.p
        if p.training_method == "rf":
            return 0.5 if h <= 0 else 0.0 if g <= 0 else min(g / h, 1.0)
        if h <= 0:
            return 0.0
        if self.n and self.account:  # noise doesn't take sums beyond what so many rows can have
            bound_g, bound_h = self.account.sensitivities()
            g, h = max(-bound_g * self.n, min(bound_g * self.n, g)), min(bound_h * self.n, h)
        c = math.copysign(max(0.0, abs(g) - p.reg_alpha), g)
        w = -c / (h + p.reg_lambda)
        return p.reg_eta * (max(-p.reg_delta, min(p.reg_delta, w)) if p.reg_delta else w)

    def _method(self, depth: int) -> str:
        p = self.p
        return (p.split_method_per_level[depth] if p.split_method_per_level else "totally_random") if p.split_method == "hybrid_random" else p.split_method

    def _mixed(self) -> bool:
        return len({self._method(d) for d in range(self.p.max_depth)}) > 1

    def random_splits(self, open_: list[Node], bounds: dict[int, dict[int, tuple[int, int]]]) -> dict[int, tuple]:
        """A split of every open node that doesn't look at data; its children's sums aren't known."""
        found = {}
        for n in open_:
            sizes = {j: len(self.cands[self.features[j]]) for j in self.use}
            free = [j for j in self.use if bounds[n.num][j][0] < min(bounds[n.num][j][1], sizes[j])]
            if free:
                j = self.rng.choice(free)
                cand = self.rng.randrange(bounds[n.num][j][0], min(bounds[n.num][j][1], sizes[j]))
                found[n.num] = j, {"cand": cand, "score": math.inf} | dict.fromkeys(("gl", "hl", "gr", "hr"), math.inf)
        return found

    def random_structure(self) -> Tree:
        """A tree whose splits don't look at data: no pass over the table."""
        tree: Tree = {}

        def at(depth: int, num: int, bounds: dict[int, tuple[int, int]]) -> None:
            node = tree[depth, num] = Node(depth, num, 0.0, 0.0)
            open_ = [j for j in self.use if bounds[j][0] < min(bounds[j][1], len(self.cands[self.features[j]]))]
            if depth == self.p.max_depth or not open_:
                return
            j = self.rng.choice(open_)
            cand = self.rng.randrange(bounds[j][0], min(bounds[j][1], len(self.cands[self.features[j]])))
            node.feature, node.threshold, node.score = j, self.cands[self.features[j]][cand], math.inf
            at(depth + 1, 2 * num - 1, bounds | {j: (bounds[j][0], cand)})
            at(depth + 1, 2 * num, bounds | {j: (cand + 1, bounds[j][1])})

        at(0, 1, {j: (0, len(self.cands[self.features[j]]) + 1) for j in self.use})
        return tree

    def level_columns(self) -> list[int]:
        """The features that a level may use."""
        return sorted(self.rng.sample(self.use, math.ceil(self.p.colsample_bylevel * len(self.use)))) if self.p.colsample_bylevel < 1 else self.use

    def split(self, x: _Growing, found: dict[int, tuple], depth: int) -> None:
        """Gives the open nodes their splits, and opens their children."""
        after, limits = [], {}
        for n in x.open:
            if n.num not in found or found[n.num][1]["score"] <= self.p.reg_gamma:
                continue
            j, r = found[n.num]
            c, own = r["cand"], x.bounds[n.num]
            n.feature, n.threshold, n.score = j, self.cands[self.features[j]][c], r["score"]
            for num, g, h, bound in ((2 * n.num - 1, r["gl"], r["hl"], (own[j][0], c)), (2 * n.num, r["gr"], r["hr"], (c + 1, own[j][1]))):
                after.append(x.tree.setdefault((depth + 1, num), Node(depth + 1, num, g, h)))
                limits[num] = own | {j: bound}
        x.open, x.bounds = after, limits

    def grow(self) -> Tree:
        return grow_all(self.rows, [self])[0]

    def sum_rows(self, tree: Tree) -> None:
        """Leaf values that are sums of each row's own update, or the sign of that sum."""
        p = self.p
        own = -F.col("g") / (F.col("h") + p.reg_lambda) if "newton" in p.weight_update_method else -F.col("g")
        got = dict(self.rows.groupBy(routed(tree, self.features, lambda n: F.lit(n.name)).alias("leaf")).agg(F.sum(own)).collect())  # a row a leaf
        for n in tree.values():
            if n.feature is None:
                w = got.get(n.name, 0.0)
                w = math.copysign(p.reg_delta, w) if "signed" in p.weight_update_method and w else w
                n.value = p.reg_eta * max(-p.reg_delta, min(p.reg_delta, w))


#: Trees that share one aggregate over the table.
TREES_PER_JOB = 16


def _in_trees(values: Sequence[Column], members: Sequence[Column | None]) -> Column:
    """One value for each tree that a row is sampled into; null for the others."""
    return F.array(*[v if m is None else F.when(m, v) for v, m in zip(values, members)])


def fill_all(rows: DataFrame, grown: list[tuple[Grower, Tree]], members: Sequence[Column | None] | None = None) -> None:
    """Sums and values of the leaves of trees whose structures are known, many trees in one pass over the rows; ``members`` tell which rows a tree has (None: all)."""
    members = members or [None] * len(grown)
    for k in range(0, len(grown), TREES_PER_JOB):
        some = grown[k : k + TREES_PER_JOB]
        places = [F.struct(F.lit(i).alias("tree"), routed(t, w.features, lambda n: F.lit(n.name)).alias("leaf")) for i, (w, t) in enumerate(some)]
        leaves = F.explode(_in_trees(places, members[k : k + TREES_PER_JOB])).alias("l")
        sums = rows.select("g", "h", leaves).where("l is not null").groupBy("l.tree", "l.leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # a row a leaf
        got = {(r["tree"], r["leaf"]): (r["g"], r["h"]) for r in sums}
        for i, (w, t) in enumerate(some):
            sg, sh = w._noise(w.p.max_depth - 1)
            for n in t.values():
                if n.feature is None and (n.h == math.inf or w._method(0) == "totally_random" and not w._mixed()):
                    g, h = got.get((i, n.name), (0.0, 0.0))
                    n.g, n.h = g + w.rng.gauss(0, sg) if sg else g, h + w.rng.gauss(0, sh) if sh else h
                    n.value = w.value(n.g, n.h)


class _Growing:
    """A tree on its way: its nodes, those that are open, and the bins their features may still be split at."""

    def __init__(self, grower: Grower, member: Column | None):
        self.w, self.member, self.tree = grower, member, {(0, 1): Node(0, 1, math.inf, math.inf)}
        self.open = [self.tree[0, 1]]
        self.bounds = {1: {j: (0, len(grower.cands[grower.features[j]]) + 1) for j in grower.use}}


def _best_splits(rows: DataFrame, asking: list[_Growing], depth: int) -> list[dict[int, tuple]]:
    """The best split of every open node of a level, for all trees in one aggregate; a tree's number is part of the node's."""
    first, spark = asking[0].w, rows.sparkSession
    p, features, method, base = first.p, first.features, first._method(depth), 1 << (depth + 1)
    uses = [x.w.level_columns() for x in asking]
    needed = sorted({j for use in uses for j in use})
    cands = {features[j]: first.cands[features[j]] for j in needed}
    nodes = []
    for i, x in enumerate(asking):
        at = {n.num: i * base + n.num for n in x.open}
        nodes.append(routed(x.tree, features, lambda n, at=at: F.lit(at[n.num]) if n.depth == depth and n.num in at else F.lit(None).cast("int")))
    if len(asking) == 1:
        placed = rows.withColumn("_node", nodes[0] if asking[0].member is None else F.when(asking[0].member, nodes[0]))
    else:
        placed = rows.withColumn("_node", F.explode(_in_trees(nodes, [x.member for x in asking])))
    placed = placed.where("_node is not null")
    bins = [F.col(f"_bin{j}") for j in needed] if "_bin0" in rows.columns else None
    hist = binning.histogram(placed, cands, F.col("g"), F.col("h"), F.col("_node"), bins, needed)
    sizes = [len(first.cands[f]) for f in features]
    if any(len(use) < len(needed) for use in uses):  # trees with columns of their own
        allowed = [(i * base + n.num, j) for i, (x, use) in enumerate(zip(asking, uses)) for n in x.open for j in use]
        hist = hist.join(F.broadcast(spark.createDataFrame(allowed, "node int, feature int")), ["node", "feature"])
    single = method in ("node_based", "partially_random")  # candidates are asked one by one: noise is on left sums
    noise = [x.w._noise(depth) for x in asking]
    told = spark.createDataFrame([(i * base + n.num, n.num, x.w._seed(depth), x.w._seed("pick"), float(sg), float(sh)) for i, (x, (sg, sh)) in enumerate(zip(asking, noise)) for n in x.open], "node int, _num int, _seed int, _pick int, _sg double, _sh double")
    drawn = F.col("_sg"), F.col("_sh"), F.col("_seed"), F.col("_num")
    noised = any(sg or sh for sg, sh in noise)
    if noised and not single:
        cells = spark.createDataFrame([(i * base + n.num, j) for i, (x, use) in enumerate(zip(asking, uses)) for n in x.open for j in use], "node int, feature int")
        hist = binning.noisy(binning.dense(hist, sizes, cells).join(F.broadcast(told), "node"), *drawn).drop(*told.columns[1:])
    limits = None
    if not p.ignore_split_constraints or p.colsample_bynode < 1:
        rows_ = []
        for i, (x, use) in enumerate(zip(asking, uses)):
            some = {n.num: set(x.w.rng.sample(use, math.ceil(p.colsample_bynode * len(use)))) for n in x.open} if p.colsample_bynode < 1 else {}
            free = lambda num, j: (0, len(first.cands[features[j]]) + 1) if p.ignore_split_constraints else x.bounds[num][j]  # noqa: E731, B023
            rows_ += [(i * base + n.num, j, *free(n.num, j)) for n in x.open for j in use if n.num not in some or j in some[n.num]]
        limits = spark.createDataFrame(rows_, "node int, feature int, lo int, hi int")
    totals = None
    if all(math.isfinite(n.g) and math.isfinite(n.h) for x in asking for n in x.open):
        totals = spark.createDataFrame([(i * base + n.num, float(n.g), float(n.h)) for i, x in enumerate(asking) for n in x.open], "node int, gn double, hn double")
    if single and noised:
        hist = hist.join(F.broadcast(told.drop("_pick")), "node")
    scored = binning.scores(hist, sizes, limits, "one-sided" if single else p.hist_estimator_method, p.reg_lambda, p.reg_alpha, p.reg_delta, totals, drawn if single and noised else None, len(uses[0]))
    if method == "partially_random":  # one candidate of each feature of each node
        scored = scored.join(F.broadcast(told.select("node", "_num", "_pick")), "node").withColumn("_u", F.xxhash64("_num", "feature", "cand", "_pick"))
        scored = scored.withColumn("_m", F.min("_u").over(binning.Window.partitionBy("node", "feature"))).where("_u = _m")
    found: list[dict[int, tuple]] = [{} for _ in asking]
    for r in binning.best(scored).collect():  # a row a node
        found[r["node"] // base][r["node"] % base] = r["feature"], r
    return found


def grow_all(rows: DataFrame, growers: Sequence[Grower], members: Sequence[Column | None] | None = None) -> list[Tree]:
    """Grows trees that don't depend on each other side by side: a level of ``TREES_PER_JOB`` of them is one aggregate over the rows.

    ``members`` are conditions that tell which rows a tree is grown on (None: all).
    """
    members = members or [None] * len(growers)
    if len(growers) > TREES_PER_JOB:
        parts = range(0, len(growers), TREES_PER_JOB)
        return [t for k in parts for t in grow_all(rows, growers[k : k + TREES_PER_JOB], members[k : k + TREES_PER_JOB])]
    first = growers[0]
    if first._method(0) == "totally_random" and not first._mixed():
        built = [(w, w.random_structure()) for w in growers]
        fill_all(rows, built, members)
        return [t for _, t in built]
    growing = [_Growing(w, m) for w, m in zip(growers, members)]
    # the root's sums: unknown above a random level, the mean over features of the first histogram, or a query of their own
    if first._method(0) in ("node_based", "partially_random"):
        own = lambda c, m: F.sum(F.col(c) if m is None else F.when(m, F.col(c)))
        got = rows.agg(*[own(c, m) for m in members for c in ("g", "h")]).first()
        for i, x in enumerate(growing):
            root, (sg, sh) = x.tree[0, 1], x.w._noise(0)
            g, h = got[2 * i] or 0.0, got[2 * i + 1] or 0.0
            root.g, root.h = g + (x.w.rng.gauss(0, sg) if sg else 0.0), h + (x.w.rng.gauss(0, sh) if sh else 0.0)
    for depth in range(first.p.max_depth):
        for x in growing:
            x.open = [n for n in x.open if n.h >= first.p.min_child_weight]
        if first._method(depth) == "totally_random":
            found = [x.w.random_splits(x.open, x.bounds) for x in growing]
        else:
            asking = [x for x in growing if x.open]
            splits = iter(_best_splits(rows, asking, depth) if asking else ())
            found = [next(splits) if x.open else {} for x in growing]
        for x, f in zip(growing, found):
            if depth == 0 and first._method(0) == "hist_based" and 1 in f:
                x.tree[0, 1].g, x.tree[0, 1].h = f[1][1]["gn"], f[1][1]["hn"]
            x.w.split(x, f, depth)
    below = [x for x in growing if any(n.feature is None and n.h == math.inf for n in x.tree.values())]
    if below:  # leaves below random levels
        fill_all(rows, [(x.w, x.tree) for x in below], [x.member for x in below])
    for x in growing:
        for n in x.tree.values():
            if n.feature is None:
                n.value = x.w.value(n.g, n.h)
    return [x.tree for x in growing]


def _binned(rows: DataFrame, features: Sequence[str], cands: dict[str, list[float]]) -> DataFrame:
    """``rows`` with a column for the bin of each feature."""
    kind = "short" if all(len(cands[f]) < 1 << 15 for f in features) else "int"
    return rows.withColumns({f"_bin{j}": binning.bin_of(F.col(f), cands[f]).cast(kind) for j, f in enumerate(features)})


def _asked(account: Accountant, n: Node) -> list[int]:
    """How many queries a row that ends in leaf ``n`` took part in, level by level.

    A histogram asks two for every feature considered, at every node that a row passes; the leaves of
    trees of random structure two; with the vector mechanism both are one.
    """
    k, unit = account.features_per_tree or 1, 1 if account.vector else 2
    if account.split_method == "totally_random":
        return [0] * (account.max_depth - 1) + [unit]
    return [unit * k if level < n.depth + (n.depth < account.max_depth) else 0 for level in range(account.max_depth)]


def ledger(df: DataFrame, model: Model, key: str, account: Accountant) -> DataFrame:
    """What each row's part in the queries cost, summed by key: key, queries, rho and epsilon (at the account's delta).

    Rows took part in the trees that sampled them only: Poisson and disjoint samples are drawn from the key again,
    exact ones by their ranks (so ``df`` must be the rows that were trained on).  rho is the sum of 1 / (2 sigma^2) over
    a row's queries, each with its own noise; the queries of rows of one key add up.
    """
    p, rows = model.params, df.withColumn("_key", F.col(key))
    share = p.row_sample_method and p.subsample < 1
    queries, rho, turn = F.lit(0).cast("long"), F.lit(0.0), 0
    for trees in model.trees.values():
        for t, tree in enumerate(trees):
            taken = _taken(p, t) if share and p.row_sample_method != "wor" else None
            if share and p.row_sample_method == "wor":
                rows = sampling.stratified_split(rows.withColumn("_one", F.lit(1)), "_one", "_key", p.subsample, p.seed + t).withColumnRenamed("train", f"_in{turn}").drop("_one")
                taken = F.col(f"_in{turn}")
            cost = [sum(1 / (2 * account.sigma_at(t, level, kind) ** 2) for kind in ((0, 0) if account.vector else (0, 1))) / 2 if account.levels()[level] else 0.0 for level in range(account.max_depth)]
            each = lambda n: sum(_asked(account, n))
            spent = lambda n, cost=cost: sum(q * c for q, c in zip(_asked(account, n), cost))
            q, r = routed(tree, model.features, lambda n: F.lit(each(n))), routed(tree, model.features, lambda n: F.lit(float(spent(n))))
            queries = queries + (q if taken is None else F.when(taken, q).otherwise(0))
            rho = rho + (r if taken is None else F.when(taken, r).otherwise(0.0))
            turn += 1
    out = rows.select(key, queries.alias("q"), rho.alias("r")).groupBy(key).agg(F.sum("q").cast("long").alias("queries"), F.sum("r").alias("rho"))
    return out.withColumn("epsilon", epsilon_column(F.col("rho"), account.delta))


def _stops(history: list[dict[str, float]], p: Params) -> bool:
    """Whether the mean of the watched sums has changed by less than the threshold from one window to the next."""
    w = p.es_window
    if not p.early_stopping or len(history) < 2 * w:
        return False
    values = [x[p.es_metric] for x in history]
    last, before = sum(values[-w:]) / w, sum(values[-2 * w : -w]) / w
    if "grad" in p.es_metric:
        last, before = abs(last), abs(before)
    return last != 0 and (before / last - 1) * 100 < p.es_threshold


#: Ways to be private; anything else is refused, as it would train without privacy.
PRIVACY = ("", "gaussian_cdp", "gaussian_ldp", "mean_mech_ldp")


def _checked(p: Params) -> Params:
    """Refuses settings that aren't known."""
    if p.dp_method not in PRIVACY:
        raise ValueError(f"unknown dp_method {p.dp_method}")
    if p.training_method not in ("boosting", "rf", "batched_boosting"):
        raise ValueError(f"unknown training method {p.training_method}")
    if p.task not in ("classification", "regression"):
        raise ValueError(f"unknown task {p.task}")
    if p.feature_interaction_method not in ("", "cyclical", "random"):
        raise ValueError(f"unknown feature interaction {p.feature_interaction_method}")
    if p.dp_method == "mean_mech_ldp" and p.sigma is not None:
        raise ValueError("mean_mech_ldp has no sigma; give an epsilon")
    if p.split_method not in (*METHODS, "hybrid_random"):
        raise ValueError(f"unknown split method {p.split_method}")
    if p.split_method == "hybrid_random" and p.split_method_per_level and (len(p.split_method_per_level) != p.max_depth or set(p.split_method_per_level) - {"hist_based", "partially_random", "totally_random"}):
        raise ValueError("split_method_per_level: one of hist_based, partially_random, totally_random for each level")
    if p.hist_estimator_method not in binning.ESTIMATORS:
        raise ValueError(f"unknown estimator {p.hist_estimator_method}")
    if p.early_stopping not in (None, "standard", "rollback", "retry", "standard_retrain", "average_retrain", "majority_retrain") or p.es_metric not in ("leaf_hess", "leaf_grad", "root_hess", "root_grad"):
        raise ValueError(f"early stopping {p.early_stopping} by {p.es_metric} isn't built")
    if p.row_sample_method not in (None, "wor", "poisson", "disjoint"):
        raise ValueError(f"unknown row sample {p.row_sample_method}")
    if _by_rows(p) and p.dp_method:
        raise ValueError("signed and per_sample updates are sums without noise")
    return p


def _by_rows(p: Params) -> bool:
    return "signed" in p.weight_update_method or "per_sample" in p.weight_update_method


def _newton(p: Params) -> bool:
    """Whether hessians are the loss's own."""
    return p.weight_update_method == "xgboost" or "newton" in p.weight_update_method or p.training_method == "rf"


def _columns(p: Params, n: int, turn: int) -> list[int]:
    """The features that a tree may use."""
    if p.feature_interaction_method == "cyclical":
        return sampling.cyclical(n, p.feature_interaction_k or 1, turn)
    if p.feature_interaction_method == "random":
        return sampling.random_k(n, p.feature_interaction_k or 1, p.seed + turn)
    return sampling.columns(n, p.colsample_bytree, p.seed + turn) if p.colsample_bytree < 1 else list(range(n))


def _taken(p: Params, t: int) -> Column | None:
    """Which rows tree ``t`` is grown on, where that is a condition on the row's key (None: all)."""
    if not p.row_sample_method or p.subsample >= 1:
        return None
    return sampling.taken_poisson("_key", p.subsample, p.seed + t) if p.row_sample_method == "poisson" else sampling.taken_disjoint("_key", p.subsample, t)


def _perturbed(graded: DataFrame, p: Params, account: Accountant, draws: str) -> DataFrame:
    """Gradients and hessians as each row reports them by itself: with Gaussian noise, or by the hybrid mechanism; draws come from the row's key."""
    seed = lambda k: random.Random(f"{draws}/{k}").getrandbits(31)
    (glo, ghi), (hlo, hhi) = account.bounds()
    if p.dp_method == "gaussian_ldp":
        sg, sh = account.sensitivities()
        s = p.sigma if p.sigma is not None else account.sigma()
        noise = lambda k: F.sqrt(-2 * F.log(local_privacy.draw("_key", seed(k)))) * F.cos(2 * F.pi() * local_privacy.draw("_key", seed(k + 1)))
        return graded.withColumns({"g": F.col("g") + s * sg * noise(0), "h": F.col("h") + s * sh * noise(2)})
    each = account.epsilon / account.classes / account.num_trees
    # hessians that are all alike tell nothing, so gradients have the tree's whole budget
    shares = (1.0, 0.0) if hlo == hhi else account.gradient_budgets

    def told(c: str, lo: float, hi: float, share: float, k: int) -> Column:
        if not share:
            return F.col(c)
        half, middle = (hi - lo) / 2, (hi + lo) / 2
        x = F.least(F.greatest((F.col(c) - middle) / half, F.lit(-1.0)), F.lit(1.0))
        return middle + half * local_privacy.bounded_report(x, "_key", each * share, "hybrid", seed(k))

    return graded.withColumns({"g": told("g", glo, ghi, shares[0], 0), "h": told("h", hlo, hhi, shares[1], 10)})


def fit(df: DataFrame, features: Sequence[str], label: str, key: str | None = None, params: Params | None = None) -> Model:
    """Trains on ``df``: its features, label and, for row samples and local privacy, a key.

    Classes 0..k-1 with k above 2 are trained one against the rest, each from
    margin 0.  Rows without a label are left out; missing feature values are in no
    bin and go right.  Without a key, rows that report privately are numbered once and stored.

    Early stopping that ends in ``_retrain`` trains again with as many trees as
    were kept: ``standard_retrain`` on all rows, with what is left of the
    budget; ``average_retrain`` and ``majority_retrain`` on the second half
    and on two more thirds of the keys, each with the whole budget, since no row is in two parts.
    """
    p = _checked(params or Params())
    if p.early_stopping and p.early_stopping.endswith("_retrain"):
        return _retrained(df, features, label, key, p)
    with scratch(df.sparkSession):
        return _fit(df, features, label, key, p)


def _retrained(df: DataFrame, features: Sequence[str], label: str, key: str | None, p: Params) -> Model:
    kind = p.early_stopping.removesuffix("_retrain")
    stopping, whole = replace(p, early_stopping="standard"), replace(p, early_stopping=None)
    if kind == "standard":
        first = fit(df, features, label, key, stopping)
        kept = max(map(len, first.trees.values()))
        left = p.epsilon - first.spent
        if kept >= p.num_trees or p.dp_method and left <= 0:
            return first
        return fit(df, features, label, key, replace(whole, num_trees=kept, epsilon=left if p.dp_method else p.epsilon))
    if not key:
        raise ValueError("training on parts of the rows needs a key")
    n = 2 if kind == "average" else 3
    part = lambda i: df.where(sampling.chunk(key, n) == i)
    first = fit(part(0), features, label, key, stopping)
    kept = max(map(len, first.trees.values()))
    others = [fit(part(i), features, label, key, replace(whole, num_trees=kept)) for i in range(1, n)]
    return Model(list(features), p, {}, first.cands, parts=[first, *others], vote=kind == "majority")


def _fit(df: DataFrame, features: Sequence[str], label: str, key: str | None, p: Params) -> Model:
    local = p.dp_method in ("gaussian_ldp", "mean_mech_ldp")
    keep = [F.col(f).cast("double").alias(f) for f in features] + [F.col(label).cast("double").alias("y")]
    keep += [F.col(key).alias("_key")] if key else [F.monotonically_increasing_id().alias("_key")] if local else []
    base = df.select(*keep).where("y is not null")
    base = stored(base) if local and not key else base
    n, top = base.agg(F.count("*"), F.max("y")).first()
    classes = 1 if p.task == "regression" else int((top or 0) + 1)
    classes = 1 if classes <= 2 else classes
    loss = LOSSES["forest" if p.training_method == "rf" else "least_squares" if p.task == "regression" else "cross_entropy"]
    ebm = p.full_ebm and p.feature_interaction_method == "cyclical"
    total = p.num_trees * (len(features) if ebm else 1)
    rounds = min(p.sketch_rounds or total, total) if p.sketch_type == "adaptive_hessian" else 0
    account = Accountant(p.epsilon, p.delta or 1 / max(n, 2), total, p.max_depth, p.split_method, p.accounting_method, sketch_epsilon(p) if p.dp_method else 0.0, classes=classes, features_per_tree=p.feature_interaction_k or len(features), vector=p.vector_mechanism, sketch_rounds=rounds, per_level=tuple(p.split_method_per_level or ()), task=p.task, update="xgboost" if _newton(p) else "gbm", forest=p.training_method == "rf", grad_clip=p.grad_clip, sample=p.row_sample_method, subsample=p.subsample, tree_budgets=tuple(p.tree_budgets), level_budgets=tuple(p.level_budgets), gradient_budgets=tuple(p.gradient_budgets))
    cands = find_candidates(base, features, p, key="_key" if key else None)
    model = Model(list(features), p, {}, cands, account=account)
    model.log.append((-1, -1, "candidates", 0, "sent", 1, 8 * sum(map(len, cands.values()))))
    batch = total if p.training_method == "rf" else batch_size(p) if p.training_method == "batched_boosting" else 1
    names = base.columns
    random_only = p.split_method == "totally_random" or p.split_method == "hybrid_random" and set(p.split_method_per_level or ["totally_random"]) == {"totally_random"}
    # trees of a batch that all read the same rows and thresholds are grown side by side
    together = batch > 1 and p.sketch_type not in ("random_uniform", "adaptive_hessian") and not _by_rows(p) and (p.row_sample_method != "wor" or p.subsample >= 1)
    if p.row_sample_method and p.subsample < 1 and not key:
        raise ValueError("row samples need a key")
    # bins are found once for each set of thresholds
    binned = stored(base if random_only else _binned(base, features, cands))
    for c in range(classes):
        trees = model.trees[c] = []
        one = lambda df: (df.withColumn("y", (F.col("y") == c).cast("double")) if classes > 1 else df)  # noqa: E731, B023
        rows = one(binned).withColumn("margin", F.lit(0.0))
        since: list[Tree] = []
        history: list[dict[str, float]] = []
        ready: dict[int, Tree] = {}
        for t in range(total):
            if t % batch == 0:
                if since and p.training_method != "rf":
                    values = [tree_value(x, features) for x in since]
                    rows = rows.withColumn("margin", F.col("margin") + sum(values[1:], values[0]) / len(values))
                    if (t // batch) % p.checkpoint_every == 0:
                        rows = stored(rows)
                since = []
                g, h = loss(F.col("y"), F.col("margin"))
                g = clipped(g, p.grad_clip) if p.task == "regression" or p.gradient_clipping else g
                h = h if _newton(p) else F.lit(1.0)
                graded = rows.withColumns({"g": g, "h": h})
                if local:  # every row is perturbed once, on its own
                    graded = stored(_perturbed(graded, p, account, f"{p.seed}/{c}/{t}"))
            if p.sketch_type == "random_uniform" and t:
                model.cands = cands = find_candidates(base, features, p, t)
                if not random_only:
                    graded = _binned(graded, features, cands)
            use = _columns(p, len(features), t)
            if together:
                if t not in ready:
                    turns = range(t, min(total, t + batch - t % batch))
                    growers = [Grower(graded, features, cands, p, account, k, _columns(p, len(features), k), c, n) for k in turns]
                    ready = dict(zip(turns, grow_all(graded, growers, [_taken(p, k) for k in turns])))
                tree, some = ready.pop(t), graded
            else:
                if p.row_sample_method == "wor" and p.subsample < 1:
                    some = sampling.without_replacement(graded, "_key", p.subsample, p.seed + t)
                else:
                    some = graded if (taken := _taken(p, t)) is None else graded.where(taken)
                grower = Grower(some, features, cands, p, account, t, use, c, n)
                tree = grower.grow()
                if _by_rows(p):
                    grower.sum_rows(tree)
            trees.append(tree)
            since.append(tree)
            model.log += _told(p, c, t, tree, use, cands, features)
            if p.sketch_type == "adaptive_hessian" and t + 1 < (p.sketch_rounds or total):
                used = {features[j]: cands[features[j]] for j in use}
                hist = binning.histogram(some, used, F.col("g"), F.col("h"))
                if p.dp_method == "gaussian_cdp":  # the refined thresholds are public: all cells get noise, which the accountant has counted
                    deviation = account.sensitivities()[1] * (p.sigma if p.sigma is not None else account.sigma())
                    hist = binning.noisy(binning.dense(hist, [len(x) for x in used.values()], base.sparkSession.createDataFrame([(1,)], "node int")), 0.0, deviation, random.Random(f"{p.seed}/{c}/{t}/sketch").getrandbits(31))
                per = [[0.0] * (len(x) + 1) for x in used.values()]
                for r in hist.select("feature", "bin", "h").collect():
                    per[r["feature"]][r["bin"]] = r["h"]
                mean = sum(map(sum, per)) / len(per)
                cands = cands | {f: candidates.hessian_refined(x, per[j], mean, p.hist_bin) or x for j, (f, x) in enumerate(used.items())}
                model.cands = cands
                model.log.append((c, t, "candidates", 0, "sent", 1, 8 * sum(len(x) + 1 for x in used.values())))
                if not random_only:
                    rows = stored(_binned(rows.select(*names, "margin"), features, cands))
            leaves = [x for x in tree.values() if x.feature is None]
            history.append({"leaf_grad": sum(x.g for x in leaves), "leaf_hess": sum(x.h for x in leaves), "root_grad": tree[0, 1].g, "root_hess": tree[0, 1].h})
            if _stops(history, p):
                if p.early_stopping == "retry":  # the last trees go, and the next ones are grown from what is left
                    drop = 2 if "root" in p.es_metric else 1
                    del trees[-drop:], history[-drop:]
                    rows, since = one(binned).withColumn("margin", model.margin(c)), []
                    continue
                if p.early_stopping == "rollback":
                    trees.pop()
                break
    if p.dp_method:
        model.spent = account.check(max(map(len, model.trees.values()))) * classes + sketch_epsilon(p) if p.dp_method == "gaussian_cdp" else p.epsilon * max(map(len, model.trees.values())) / total
    return model


def _told(p: Params, class_id: int, t: int, tree: Tree, use: Sequence[int], cands: dict[str, list[float]], features: Sequence[str]) -> list[tuple]:
    """What growing a tree would send between the rows' owners and a server: (class, tree, kind, level, direction, rounds, bytes).

    Histograms are two numbers of eight bytes for each bin of each node that is
    asked about, one round a level; leaves of trees of random structure are two
    numbers each; the server answers with a feature and a threshold for each split.
    """
    out, bins = [], sum(len(cands[features[j]]) + 1 for j in use)
    random_ = p.split_method == "totally_random"
    for depth in range(p.max_depth):
        splits = sum(x.depth == depth and x.feature is not None for x in tree.values())
        asked = sum(x.depth == depth for x in tree.values())
        if asked and not random_:
            out.append((class_id, t, "histogram", depth, "sent", 1, 16 * bins * asked))
        if splits:
            out.append((class_id, t, "splits", depth, "received", 1, 16 * splits))
    if random_:
        out.append((class_id, t, "leaves", p.max_depth, "sent", 1, 16 * sum(x.feature is None for x in tree.values())))
    return out


__all__ = ["PRESETS", "Grower", "Model", "Node", "Params", "find_candidates", "fit", "forest_value", "gain", "leaf_value", "stored"]
