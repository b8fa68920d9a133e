"""Privacy budgets: Renyi curves of Gaussian mechanisms, calibration, composition, and how a training run spends them."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The orders at which curves are evaluated.
ORDERS = [1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 3.0, 3.5, 4.0, 4.5, *map(float, range(5, 64)), 128.0, 256.0, 512.0]


def rdp(sigma: float, queries: float = 1, orders: list[float] = ORDERS) -> list[float]:
    """Renyi divergence of ``queries`` Gaussian mechanisms of sensitivity 1."""
    return [queries * a / (2 * sigma * sigma) for a in orders]


def _cost(order: float, delta: float) -> float:
    return math.log1p(-1 / order) - math.log(delta * order) / (order - 1)


def epsilon_of(curve: list[float], delta: float, orders: list[float] = ORDERS) -> float:
    """The smallest epsilon that a curve gives at ``delta``."""
    return max(0.0, min(r + _cost(a, delta) for a, r in zip(orders, curve)))


def epsilon_column(rho: Column, delta: float, orders: list[float] = ORDERS) -> Column:
    """The epsilon at ``delta`` of Gaussian mechanisms whose 1 / (2 sigma^2) sum up to ``rho``, row by row; nothing asked costs nothing.

    Mechanisms of different noise compose by adding their curves, each of which is its order times 1 / (2 sigma^2).
    """
    curve = F.transform(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(_cost(a, delta)).alias("c")) for a in orders]), lambda o: o["a"] * rho + o["c"])
    return F.when(rho > 0, F.greatest(F.array_min(curve), F.lit(0.0))).otherwise(F.lit(0.0))


def sigma_for(epsilon: float, queries: float, delta: float, orders: list[float] = ORDERS) -> float:
    """The least noise for which ``queries`` unit-sensitivity mechanisms stay within (epsilon, delta)."""
    fits = [math.sqrt(queries * a / (2 * (epsilon - c))) for a in orders if epsilon > (c := _cost(a, delta))]
    if not fits:
        raise ValueError("no order reaches this epsilon")
    return min(fits)


@lru_cache(4096)
def subsampled_rdp(sigma: float, rate: float, order: float) -> float:
    """Renyi divergence of a Poisson-subsampled Gaussian mechanism, at any order above 1.

    It is log(E[(1 - rate + rate * exp((2z - 1) / (2 sigma^2)))^order]) / (order - 1) for z normal with deviation sigma: an
    integral of a smooth bump, which evenly spaced points find to rounding.
    """
    if rate <= 0:
        return 0.0
    if rate >= 1:
        return order / (2 * sigma * sigma)
    # the integrand falls off as a normal density around 0 and around the order
    z = np.linspace(-12 * sigma, order + 12 * sigma, 2 * math.ceil(20 * (24 + order / sigma)) + 1)
    inner = np.logaddexp(math.log1p(-rate), math.log(rate) + (2 * z - 1) / (2 * sigma * sigma))
    terms = order * inner - z * z / (2 * sigma * sigma)
    top = float(terms.max())
    whole = top + math.log(float(np.exp(terms - top).sum()) * (z[1] - z[0])) - math.log(sigma * math.sqrt(2 * math.pi))
    return max(0.0, whole / (order - 1))


#: Orders at which subsampled mechanisms are composed.
SAMPLED_ORDERS = [1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 3.0, 3.5, 4.0, 4.5, *map(float, range(5, 65)), 96.0, 128.0]


@lru_cache(256)
def subsampled_sigma(epsilon: float, delta: float, rate: float, rounds: float) -> float:
    """The noise for ``rounds`` subsampled mechanisms, by bisection."""
    spent = lambda s: min(rounds * subsampled_rdp(s, rate, a) + _cost(a, delta) for a in SAMPLED_ORDERS)
    lo, hi = 0.5, 1.0
    while spent(hi) > epsilon:
        lo, hi = hi, 2 * hi
    while spent(lo) <= epsilon:
        lo, hi = lo / 2, lo
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if spent(mid) > epsilon else (lo, mid)
    return hi


def sigma_by(method: str, epsilon: float, delta: float, queries: int) -> float:
    """The noise of a query under a composition method: rdp, basic, advanced or closed (a weak closed form)."""
    if method.startswith("rdp"):
        return sigma_for(epsilon, queries, delta)
    if method == "basic":
        return queries * math.sqrt(2 * math.log(1.25 * queries / delta)) / epsilon
    if method == "advanced":
        each = epsilon / (2 * math.sqrt(2 * queries * math.log(2 * queries / delta)))
        return math.sqrt(2 * math.log(1.25 * 2 * queries / delta)) / each
    return math.sqrt(queries * (2 * math.log(1 / delta) + 2 * epsilon)) / epsilon


@dataclass
class Accountant:
    """How the budget of a training run is split over trees, levels, and gradient and hessian queries."""

    epsilon: float = 1.0
    delta: float = 1e-5
    num_trees: int = 2
    max_depth: int = 6
    split_method: str = "hist_based"
    method: str = "rdp_scaled_improved"
    quantile_epsilon: float = 0.0
    classes: int = 1
    features_per_tree: int | None = None
    vector: bool = False
    sketch_rounds: int = 0
    task: str = "classification"
    update: str = "xgboost"
    forest: bool = False
    grad_clip: float = 20.0
    spent: int = field(default=0)
    per_level: tuple[str, ...] = ()
    sample: str | None = None
    subsample: float = 1.0
    tree_budgets: tuple[float, ...] = ()
    level_budgets: tuple[float, ...] = ()
    gradient_budgets: tuple[float, float] = (0.5, 0.5)

    def sensitivities(self) -> tuple[float, float]:
        """Of a row's gradient and hessian."""
        if self.forest:
            return 1.0, 1.0
        if self.task == "regression":
            return self.grad_clip, 1.0
        return 1.0, 0.25 if self.update == "xgboost" else 1.0

    def bounds(self) -> tuple[tuple[float, float], tuple[float, float]]:
        """The ranges of a row's gradient and hessian."""
        if self.forest:
            return (0.0, 1.0), (1.0, 1.0)
        if self.task == "regression":
            return (-self.grad_clip, self.grad_clip), (1.0, 1.0)
        return (-1.0, 1.0), (0.0, 0.25) if self.update == "xgboost" else (1.0, 1.0)

    def methods(self) -> list[str]:
        """The split method of every level."""
        if self.split_method == "hybrid_random":
            return list(self.per_level or ["totally_random"] * self.max_depth)
        return [self.split_method] * self.max_depth

    def levels(self) -> list[float]:
        """Shares of the levels: all alike, but none for those whose splits need no data; the last has the leaves."""
        asks = [m != "totally_random" or i == self.max_depth - 1 for i, m in enumerate(self.methods())]
        if self.level_budgets:
            own = [b if a else 0.0 for a, b in zip(asks, self.level_budgets)]
            return [b / sum(own) for b in own]
        return [1 / sum(asks) if a else 0.0 for a in asks]

    def queries(self) -> int:
        k = self.features_per_tree or 1
        asking = sum(m != "totally_random" for m in self.methods())
        n = asking * self.num_trees * 2 * k + (2 * self.num_trees if asking < self.max_depth else 0)  # sums of leaves below random levels
        if self.split_method in ("node_based", "partially_random"):
            n += self.num_trees
        return max(1, (n // 2 if self.vector else n) + self.sketch_rounds * k)  # a sketch asks for hessians alone

    def sigma(self) -> float:
        """The noise of a query of sensitivity 1 where all queries are alike."""
        epsilon, n = (self.epsilon - self.quantile_epsilon) / self.classes, self.queries()
        if self.sample == "disjoint":  # a row takes part in one chunk's trees only
            n = max(1, n * self.subsample)
        if self.sample == "poisson" and self.subsample < 1:
            return subsampled_sigma(epsilon, self.delta, self.subsample, n)
        return sigma_by(self.method, epsilon, self.delta, n)

    def sigma_at(self, tree: int, level: int, kind: int) -> float:
        """The noise of a tree's and level's gradients (kind 0) or hessians (1): shares of the budget of their own scale it; 0 where nothing is asked."""
        share = self.levels()[level]
        if not share:
            return 0.0
        trees, asked = self.tree_budgets or (1 / self.num_trees,) * self.num_trees, sum(b > 0 for b in self.levels())
        parts = trees[tree] * self.num_trees * share * asked * (1 if self.vector else self.gradient_budgets[kind] * 2)
        return self.sigma() / math.sqrt(parts)

    def check(self, trees: int | None = None) -> float:
        """The epsilon that all queries (or those of the first ``trees`` trees) together spend at ``delta``, by composing their curves; at most what was given."""
        asked = [(self.sigma_at(t, d, k), 1) for t in range(self.num_trees if trees is None else min(trees, self.num_trees)) for d, b in enumerate(self.levels()) if b for k in ((0,) if self.vector else (0, 1))]
        if not asked:
            return 0.0
        every = self.num_trees * sum(b > 0 for b in self.levels()) * (1 if self.vector else 2)
        per = self.queries() * (self.subsample if self.sample == "disjoint" else 1) / every
        if self.sample == "poisson" and self.subsample < 1:
            noise = Counter(s for s, _ in asked)
            curve = [sum(per * times * subsampled_rdp(s, self.subsample, a) for s, times in noise.items()) for a in SAMPLED_ORDERS]
            return epsilon_of(curve, self.delta, SAMPLED_ORDERS)
        return epsilon_of([sum(per * a / (2 * s * s) for s, _ in asked) for a in ORDERS], self.delta)

    def noise(self, level: int, tree: int = 0) -> tuple[float, float]:
        """Standard deviations of the noise on gradient and hessian sums of a level (from 0)."""
        level = min(level, self.max_depth - 1)
        if not self.levels()[level]:
            return 0.0, 0.0
        g, h = self.sensitivities()
        both = math.hypot(g, h)
        self.spent += 1 if self.vector else 2
        sg, sh = self.sigma_at(tree, level, 0), self.sigma_at(tree, level, 1)
        return (both * sg, both * sg) if self.vector else (g * sg, h * sh)

    def table(self, spark: SparkSession) -> DataFrame:
        """(tree, level, kind, share, sigma), one row for each component of the budget: what a training run draws its noise by."""
        trees = self.tree_budgets or (1 / self.num_trees,) * self.num_trees
        rows = [(t, d, kind, share * trees[t] * self.gradient_budgets[k], self.sigma_at(t, d, k)) for t in range(self.num_trees) for d, share in enumerate(self.levels()) for k, kind in enumerate(("gradient", "hessian"))]
        return spark.createDataFrame(rows, "tree int, level int, kind string, share double, sigma double")
