"""All queries of the library by name, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.gains import forest_value, gain, leaf_value
from .functions.losses import log_loss, sigmoid, softmax, softmax_cross_entropy
from .operators import binning, candidates, joint_quantiles, local_privacy, metrics, ordering, private_quantiles, sampling, summaries
from .plans import analytics, feature_bins, privacy, sweeps, trees
from .sources import datasets
from .streaming import histograms

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
Q = 32


def query(oracle: str | None = None):
    """Registers a query by the name of its function, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _train(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").select(*FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("y"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", "value", "event_type", (F.col("event_type") == "purchase").cast("int").alias("y"))


def _first_step(df: DataFrame) -> tuple:
    """Gradient and hessian at margin 0, exact in binary."""
    return 0.5 - F.col("y"), F.lit(0.25)


# --- SQL building blocks ---------------------------------------------------------------------------------------------
_T = "t AS (SELECT l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"
_U = "u AS (" + " UNION ALL ".join(f"SELECT {j} AS feature, f{j} AS x, y FROM t" for j in range(4)) + ")"
_C = f"c AS (SELECT feature, min(x) AS mn, (max(x) - min(x)) / {Q} AS st, max(x) AS mx FROM u GROUP BY feature), k AS (SELECT feature, i AS cand, mn + i * st AS v FROM c, range({Q}) r(i)), ks AS (SELECT feature, list(v ORDER BY cand) AS vs FROM k GROUP BY feature)"
_B = "b AS (SELECT u.feature, len(list_filter(vs, lambda v: v + 1e-11 <= x)) AS bin, y FROM u JOIN ks USING (feature))"
_H = "h AS (SELECT feature, bin, sum(0.5 - y)::DOUBLE AS g, sum(0.25)::DOUBLE AS h, count(*) AS n FROM b GROUP BY ALL)"


def _sql_gain(g: str, h: str, lam: float = 1, alpha: float = 0, delta: float = 2) -> str:
    c = f"(CASE WHEN {g} > {alpha} THEN {g} - {alpha} WHEN {g} < -{alpha} THEN {g} + {alpha} ELSE 0.0 END)::DOUBLE" if alpha else f"({g})"
    w = f"(-{c} / ({h} + {lam}))"
    d = f"(CASE WHEN {w} < 0 THEN -{float(delta)}::DOUBLE ELSE {float(delta)}::DOUBLE END)"
    return f"(CASE WHEN abs({w}) > {delta} THEN -(2 * {g} * {d} + ({h} + {lam}) * {d} * {d}) + {alpha} * abs({d}) ELSE -{w} * {c} END)"


def _sql_scores(**kw) -> str:
    parts = f"0.5 * ({_sql_gain('gl', 'hl', **kw)} + {_sql_gain('gr', 'hr', **kw)} - {_sql_gain('gt', 'ht', **kw)})"
    return f"s0 AS (SELECT feature, bin AS cand, sum(g) OVER (PARTITION BY feature ORDER BY bin) AS gl, sum(h) OVER (PARTITION BY feature ORDER BY bin) AS hl, sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht FROM h), s1 AS (SELECT *, gt - gl AS gr, ht - hl AS hr FROM s0 WHERE cand < {Q}), s AS (SELECT feature, cand, gl, hl, gr, hr, {parts} AS score FROM s1)"


def _sql_tree(p: str, src: str, depth: int, n: int = 4, estimator: str | None = None) -> list[str]:
    """Growth of one tree, level by level, over ``src`` (rid, f0.., g, h): the CTEs, of which {p}n holds the nodes and {p}v the rows' values."""
    fs = ", ".join(f"f{j}" for j in range(n))
    by = "PARTITION BY num, feature"
    out = [f"{p}w0 AS MATERIALIZED (SELECT rid, 1 AS num, {fs}, g, h FROM {src})", f"{p}l0 AS (SELECT 1 AS num, feature, 0 AS lo, {Q + 1} AS hi FROM ks)"]
    for d in range(depth):
        each = " UNION ALL ".join(f"SELECT num, {j} AS feature, f{j} AS x, g, h FROM {p}w{d}" for j in range(n))
        out.append(f"{p}b{d} AS MATERIALIZED (SELECT num, feature, len(list_filter(vs, lambda v: v + 1e-11 <= x)) AS bin, sum(g)::DOUBLE AS g, sum(h)::DOUBLE AS h FROM ({each}) JOIN ks USING (feature) GROUP BY ALL)")
        mean = f"SELECT num, sum(g) / {n} AS gn, sum(h) / {n} AS hn FROM {p}b{d} GROUP BY num"
        if d == 0:
            out.append(f"{p}t0 AS MATERIALIZED ({mean})")
        used = f"({mean})" if estimator == "two_sided_averaging" else f"{p}t{d}"
        out.append(f"{p}c{d} AS MATERIALIZED (SELECT num, feature, bin AS cand, sum(g) OVER ({by} ORDER BY bin) AS gl, sum(h) OVER ({by} ORDER BY bin) AS hl, sum(g) OVER ({by}) AS gt, sum(h) OVER ({by}) AS ht, sum(CASE WHEN bin < hi THEN g ELSE 0 END) OVER ({by}) AS gm, sum(CASE WHEN bin < hi THEN h ELSE 0 END) OVER ({by}) AS hm FROM {p}b{d} JOIN {p}l{d} USING (num, feature) WHERE bin BETWEEN lo AND hi)")
        whole, node = ("gn", "hn") if estimator == "one-sided" else ("gt", "ht"), ("gm", "hm") if estimator == "two_sided" else ("gn", "hn")
        out.append(f"{p}s{d} AS (SELECT *, {whole[0]} - gl AS gr, {whole[1]} - hl AS hr FROM {p}c{d} JOIN {used} AS z USING (num) WHERE cand < {Q})")
        score = f"0.5 * ({_sql_gain('gl', 'hl')} + {_sql_gain('gr', 'hr')} - {_sql_gain(*node)})"
        out.append(f"{p}m{d} AS MATERIALIZED (SELECT * FROM (SELECT num, feature, cand, v AS threshold, gl, hl, gr, hr, score FROM (SELECT *, {score} AS score FROM {p}s{d}) JOIN k USING (feature, cand) QUALIFY row_number() OVER (PARTITION BY num ORDER BY score DESC, feature, cand) = 1) WHERE score > 1e-7)")
        case = "CASE m.feature " + " ".join(f"WHEN {j} THEN f{j}" for j in range(n)) + " END"
        out.append(f"{p}w{d + 1} AS MATERIALIZED (SELECT rid, CASE WHEN {case} <= threshold THEN 2 * w.num - 1 ELSE 2 * w.num END AS num, {fs}, g, h FROM {p}w{d} w JOIN {p}m{d} m ON w.num = m.num)")
        out.append(f"{p}l{d + 1} AS MATERIALIZED (SELECT 2 * m.num - 1 AS num, l.feature, lo, CASE WHEN l.feature = m.feature THEN m.cand ELSE hi END AS hi FROM {p}m{d} m JOIN {p}l{d} l ON l.num = m.num UNION ALL SELECT 2 * m.num, l.feature, CASE WHEN l.feature = m.feature THEN m.cand + 1 ELSE lo END, hi FROM {p}m{d} m JOIN {p}l{d} l ON l.num = m.num)")
        out.append(f"{p}t{d + 1} AS MATERIALIZED (SELECT 2 * num - 1 AS num, gl AS gn, hl AS hn FROM {p}m{d} UNION ALL SELECT 2 * num, gr, hr FROM {p}m{d})")
    inner = [f"SELECT {d} AS depth, num, feature, threshold, NULL::DOUBLE AS value, score AS gain, gn AS g, hn AS h FROM {p}m{d} JOIN {p}t{d} USING (num)" for d in range(depth)]
    value = "CASE WHEN hn <= 0 THEN 0.0 ELSE 0.3 * greatest(-2.0::DOUBLE, least(2.0::DOUBLE, -gn / (hn + 1))) END"
    leaf = [f"SELECT {d} AS depth, num, NULL AS feature, NULL::DOUBLE AS threshold, {value} AS value, 0.0::DOUBLE AS gain, gn AS g, hn AS h FROM {p}t{d}" + (f" WHERE num NOT IN (SELECT num FROM {p}m{d})" if d < depth else "") for d in range(depth + 1)]
    out.append(f"{p}n AS MATERIALIZED ({' UNION ALL '.join(inner + leaf)})")
    out.append(f"{p}v AS MATERIALIZED ({' UNION ALL '.join(f'SELECT rid, value FROM {p}w{d} JOIN {p}n USING (num) WHERE depth = {d} AND value IS NOT NULL' for d in range(depth + 1))})")
    return out


def _sql_boosted(ys: list[str], depth: int, rounds: int = 1, base: str = "", n: int = 4, estimator: str | None = None) -> list[str]:
    """CTEs of boosted trees for each label expression (class): nodes are in nodes, the margins after tree t of class c in x{c}_{t + 1}."""
    out, tables = [f"r AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM t)"], []
    for c, y in enumerate(ys):
        out.append(f"x{c}_0 AS (SELECT rid, 0.0::DOUBLE AS m FROM r)")
        for t in range(rounds):
            grad = base or f"1 / (1 + exp(-m)) - {y} AS g, 1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) AS h"
            out.append(f"g{c}_{t} AS MATERIALIZED (SELECT r.*, {grad} FROM r JOIN x{c}_{t} USING (rid))")
            out += _sql_tree(f"q{c}_{t}_", f"g{c}_{t}", depth, n, estimator)
            out.append(f"x{c}_{t + 1} AS MATERIALIZED (SELECT rid, m + value AS m FROM x{c}_{t} JOIN q{c}_{t}_v USING (rid))")
            tables.append(f"SELECT {c} AS class_id, {t} AS tree_id, * FROM q{c}_{t}_n")
    return [*out, f"nodes AS ({' UNION ALL '.join(tables)})"]


_NODES = "SELECT class_id::INT AS class_id, tree_id::INT AS tree_id, depth || '_' || num AS node_id, depth::INT AS depth, num::INT AS num, feature::INT AS feature, round(threshold, 6) + 0.0 AS threshold, round(value, 8) + 0.0 AS value, round(gain, 5) + 0.0 AS gain, round(g, 6) + 0.0 AS g, round(h, 6) + 0.0 AS h FROM nodes"


def _sql_trees(depth: int, rounds: int = 1, estimator: str | None = None) -> str:
    return f"WITH {_T}, {_U}, {_C}, " + ", ".join(_sql_boosted(["y"], depth, rounds, estimator=estimator))


def _nodes(spark: SparkSession, model) -> DataFrame:
    """A model's nodes, rounded; a sum of 0 has no sign."""
    return model.table(spark).withColumns({c: F.round(c, k) + F.lit(0.0) for c, k in (("threshold", 6), ("value", 8), ("gain", 5), ("g", 6), ("h", 6))})


_BASE = f"WITH {_T}, {_U}, {_C}, {_B}, {_H}"


def _hist(spark: SparkSession, d: str):
    df = _train(spark, d)
    cands = candidates.uniform(df, FEATURES, Q)
    return binning.histogram(df, cands, *_first_step(df)), cands


# --- scans, encodings, samples ---------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_discount > 0.05 AND l_quantity <= 10")
def scan_project_filter(spark, d):
    """Pruned columns, pushed filters."""
    return _table(spark, d, "lineitem").where("l_discount > 0.05 and l_quantity <= 10").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("SELECT CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS y, count(*) AS n FROM events GROUP BY ALL")
def label_predicate(spark, d):
    return _table(spark, d, "events").select(F.col("event_type").isin("purchase", "click").cast("int").alias("y")).groupBy("y").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM orders")
def dict_encode_sorted(spark, d):
    return sampling.sorted_codes(_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("WITH f AS (SELECT event_type, min(event_id) AS k FROM events GROUP BY 1), r AS (SELECT event_type, (row_number() OVER (ORDER BY k) - 1)::INT AS code FROM f) SELECT event_id, code FROM events JOIN r USING (event_type)")
def factorize_first_seen(spark, d):
    return sampling.first_seen_codes(_table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", "code").select("event_id", "code")


@query("SELECT count(*) AS kept FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND user_id IS NOT NULL")
def dropna_counts(spark, d):
    return _table(spark, d, "events").select("value", "user_id").dropna().agg(F.count("*").alias("kept"))


@query("SELECT l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY l_returnflag")
def class_balance(spark, d):
    n = _table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(binning.Window.partitionBy()), 6))  # one row a class


@query("SELECT " + ", ".join(f"round(corr({f}, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS {f}" for f in FEATURES) + " FROM lineitem")
def feature_label_corr(spark, d):
    return _train(spark, d).agg(*[F.round(F.corr(f, "y"), 6).alias(f) for f in FEATURES])


@query()
def stratified_split(spark, d):
    """70 per cent of each class, by a hash of the key (the hash is Spark's, so counts are tested, not compared with SQL)."""
    return sampling.stratified_split(_events(spark, d).select("event_id", "y"), "y", "event_id")


@query("SELECT event_type, floor(0.7 * count(*) + 0.5)::BIGINT AS train FROM events GROUP BY 1")
def stratified_split_counts(spark, d):
    split = sampling.stratified_split(_events(spark, d).select("event_id", "event_type"), "event_type", "event_id")
    return split.groupBy("event_type").agg(F.count_if("train").alias("train"))


@query("SELECT floor(0.25 * count(*) + 0.5)::BIGINT AS n FROM events")
def sample_without_replacement(spark, d):
    return sampling.without_replacement(_events(spark, d), "event_id", 0.25).agg(F.count("*").alias("n"))


@query()
def sample_poisson(spark, d):
    return sampling.poisson(_events(spark, d), "event_id", 0.25)


# --- candidates ------------------------------------------------------------------------------------------------------
def _cands(spark, cands: dict) -> DataFrame:
    return spark.createDataFrame([(f, i, float(v)) for f, c in cands.items() for i, v in enumerate(c)], "feature string, i int, v double").withColumn("v", F.round("v", 6))


_E = "e AS (SELECT value::DOUBLE AS x FROM events WHERE value IS NOT NULL AND NOT isnan(value))"


@query(f"WITH {_T}, {_U}, {_C} SELECT feature, cand::INT AS i, v FROM k")
def cand_uniform(spark, d):
    c = candidates.uniform(_train(spark, d), FEATURES, Q)
    return spark.createDataFrame([(j, i, v) for j, f in enumerate(FEATURES) for i, v in enumerate(c[f])], "feature int, i int, v double")


@query(f"WITH {_T}, {_U}, p AS (SELECT feature, i, quantile_cont(x, [{', '.join(f'{i / Q}' for i in range(Q))}]) AS qs FROM u, (SELECT 0 AS i) GROUP BY ALL) SELECT feature, j::INT AS i, round(qs[j + 1], 9) AS v FROM p, range({Q}) r(j)")
def cand_exact_quantiles(spark, d):
    c = candidates.exact_quantiles(_train(spark, d), FEATURES, Q)
    return spark.createDataFrame([(j, i, v) for j, f in enumerate(FEATURES) for i, v in enumerate(c[f])], "feature int, i int, v double").withColumn("v", F.round("v", 9))


@query(f"WITH {_E}, n AS (SELECT x, sum(count(*)) OVER (ORDER BY x) / sum(count(*)) OVER () AS p FROM e GROUP BY x), w AS (SELECT x, p, lead(x) OVER (ORDER BY x) AS nx, lead(p) OVER (ORDER BY x) AS np, row_number() OVER (ORDER BY x) AS r FROM n), g AS (SELECT i::INT AS i, i / 32.0::DOUBLE AS r0 FROM range(32) z(i)), a AS (SELECT g.i, x + (r0 - p) * (nx - x) / (np - p) AS v FROM g JOIN w ON r0 >= p AND r0 < np), f AS (SELECT g.i, x + (r0 - p) * (nx - x) / (np - p) AS v FROM g, w WHERE w.r = 1 AND r0 < p) SELECT 'value' AS feature, i, round(v, 6) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM f)")
def cand_exact_icdf(spark, d):
    return _cands(spark, {"value": candidates.exact_icdf(_events(spark, d), "value", Q)})


_LOG = "m AS (SELECT min(x) AS lo, max(x) AS hi, avg(power(x - a, 3)) / power(avg(power(x - a, 2)), 1.5) AS sk FROM e, (SELECT avg(x) AS a FROM e))"


def _sql_log(q: int) -> str:
    return f"SELECT CASE WHEN sk >= 0 THEN exp(i * (ln(1 + hi - lo) / {q})) + lo - 1 ELSE lo + hi - (exp(i * (ln(1 + hi - lo) / {q})) + lo - 1) END AS v FROM m, range({q}) z(i)"


@query(f"WITH {_E}, {_LOG}, l AS ({_sql_log(32)}) SELECT 'value' AS feature, (row_number() OVER (ORDER BY v) - 1)::INT AS i, round(v, 6) AS v FROM l")
def cand_log(spark, d):
    return _cands(spark, {"value": candidates.log(_events(spark, d), "value", Q)})


@query(f"WITH {_E}, {_LOG}, l AS ({_sql_log(16)} UNION ALL SELECT lo + i * ((hi - lo) / 16) FROM m, range(16) z(i)) SELECT 'value' AS feature, (row_number() OVER (ORDER BY v) - 1)::INT AS i, round(v, 6) AS v FROM l")
def cand_log_uniform(spark, d):
    return _cands(spark, {"value": candidates.log_uniform(_events(spark, d), "value", Q)})


_Z = "z0 AS (SELECT *, (SELECT count(*)::DOUBLE FROM e) AS n FROM m), z1 AS (SELECT *, sk * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y, -1 + sqrt(2 * (3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w2 FROM z0), z2 AS (SELECT *, y / sqrt(2.0 / (w2 - 1)) AS a FROM z1), z AS (SELECT abs(ln(a + sqrt(a * a + 1)) / sqrt(0.5 * ln(w2))) >= 1.959963984540054 AS skewed FROM z2)"


@query(f"WITH {_E}, {_LOG}, {_Z}, l AS (SELECT v FROM ({_sql_log(32)}), z WHERE skewed UNION ALL SELECT lo + i * ((hi - lo) / 32) FROM m, range(32) r(i), z WHERE NOT skewed) SELECT 'value' AS feature, (row_number() OVER (ORDER BY v) - 1)::INT AS i, round(v, 6) AS v FROM l")
def cand_skew_test(spark, d):
    """Logarithmic where the skew is significant."""
    return _cands(spark, {"value": candidates.skew_test(_events(spark, d), "value", Q)})


@query()
def cand_sketch(spark, d):
    """Rank errors are tested against exact ranks."""
    return _cands(spark, candidates.sketch(_train(spark, d), FEATURES, Q))


@query("SELECT 'p_size' AS feature, (row_number() OVER (ORDER BY v) - 1)::INT AS i, v FROM (SELECT DISTINCT p_size::DOUBLE AS v FROM part)")
def cand_categorical(spark, d):
    return _cands(spark, {"p_size": candidates.categorical(_table(spark, d, "part"), "p_size")})


@query(f"WITH {_E}, m AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 1024 AS w FROM e), c AS (SELECT least(floor((x - lo) / w), 1023) AS b, count(*) AS n FROM e, m GROUP BY 1), a AS (SELECT b, sum(n) OVER (ORDER BY b)::DOUBLE / sum(n) OVER () AS cum FROM c), t AS (SELECT k::INT AS i, (k + 1) / 32.0::DOUBLE AS target FROM range(32) z(k)), f AS (SELECT i, target, b, cum FROM t JOIN a ON cum >= target QUALIFY row_number() OVER (PARTITION BY i ORDER BY b) = 1) SELECT 'value' AS feature, i, round(CASE WHEN b = 1023 THEN lo + b * w ELSE lo + b * w + (lo + (b + 1) * w - (lo + b * w)) * (CASE WHEN cum > target THEN (cum - target) * 32 ELSE 0 END) END, 6) AS v FROM f, m")
def cand_histogram_quantiles(spark, d):
    """Without noise."""
    return _cands(spark, {"value": candidates.histogram_quantiles(_events(spark, d), "value", Q)})


@query()
def cand_dp_histogram(spark, d):
    return _cands(spark, {"value": candidates.histogram_quantiles(_events(spark, d), "value", Q, epsilon=1.0, seed=1)})


@query()
def cand_dp_quantiles(spark, d):
    """All quantiles at once under central privacy; accuracy is tested."""
    return _cands(spark, trees.find_candidates(_events(spark, d).select("event_id", F.col("value").cast("double").alias("value")), ["value"], trees.Params(sketch_type="dp_quantiles", quantile_epsilon=1.0), key="event_id"))


@query()
def cand_ldp_hist(spark, d):
    """Local hashing reports of 1024 cells; accuracy is tested."""
    return _cands(spark, trees.find_candidates(_events(spark, d), ["value"], trees.Params(sketch_type="ldp_hist", quantile_epsilon=4.0), key="event_id"))


@query()
def cand_ldp_quantiles(spark, d):
    """Square-wave reports; accuracy is tested."""
    return _cands(spark, trees.find_candidates(_events(spark, d), ["value"], trees.Params(sketch_type="ldp_quantiles", quantile_epsilon=4.0), key="event_id"))


@query()
def cand_random(spark, d):
    return _cands(spark, candidates.random_points(_train(spark, d), FEATURES, Q, seed=1))


@query()
def cand_adaptive_hessian(spark, d):
    """One round of refinement from the root's hessians; tested on hand-made histograms."""
    hist, cands = _hist(spark, d)
    per = [[0.0] * (Q + 1) for _ in FEATURES]
    for r in hist.select("feature", "bin", "h").collect():
        per[r["feature"]][r["bin"]] = r["h"]
    mean = sum(map(sum, per)) / len(per)
    return _cands(spark, {f: candidates.hessian_refined(cands[f], per[j], mean, Q) for j, f in enumerate(FEATURES)})


# --- stored summaries and sparse rows --------------------------------------------------------------------------------
@query("SELECT ts::DATE AS day, 'value' AS feature, count(value) FILTER (NOT isnan(value)) AS n, count(*) - count(value) FILTER (NOT isnan(value)) AS missing, min(value) FILTER (NOT isnan(value)) AS lo, max(value) FILTER (NOT isnan(value)) AS hi FROM events GROUP BY 1")
def daily_summaries(spark, d):
    """A summary for each day, as it is stored; the sketch itself has no SQL."""
    return summaries.summarised(_table(spark, d, "events"), ["value"], [F.to_date("ts").alias("day")]).drop("sketch")


@query(f"WITH {_E} SELECT i::INT AS i, (SELECT count(*) FROM e) AS n, true AS near FROM range(32) z(i)")
def merged_summary_thresholds(spark, d):
    """Thresholds from daily summaries that were written and merged, held against exact ranks: within twice the stated rank error."""
    e, path = _table(spark, d, "events"), f"{ordering.folder(spark)}/summaries-{uuid.uuid4().hex}"
    summaries.append(summaries.summarised(e, ["value"], [F.to_date("ts").alias("day")]), path)
    found = summaries.thresholds(summaries.merged(summaries.read(spark, path)), Q)
    x = e.select(F.col("value").alias("x")).where("x is not null and not isnan(x)")
    exact = x.join(F.broadcast(found), F.lit(True)).groupBy("i").agg(F.count_if(F.col("x") < F.col("v")).alias("below"), F.count_if(F.col("x") <= F.col("v")).alias("upto"), F.count("*").alias("n"))  # 32 thresholds against all rows
    at, slack = (F.col("i") + 1) / Q * F.col("n"), 2 * summaries.ERROR * F.col("n") + 1
    return exact.select("i", "n", ((F.col("below") <= at + slack) & (F.col("upto") >= at - slack)).alias("near"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


def _sparse_rows(spark, d) -> DataFrame:
    """Four events each as a map from the number of an event type to the sum of its values, what is 0 left out; y tells whether one was a purchase."""
    kind = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("event_type")).cast("int")
    e = _table(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("r"), kind.alias("k"), F.when(~F.isnan("value"), F.floor("value") - 30).cast("double").alias("v"))
    sums = e.where("k > 0").groupBy("r", "k").agg(F.sum("v").alias("v")).where("v <> 0")
    maps = sums.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("x"))  # one entry an event type
    return e.groupBy("r").agg(F.max((F.col("k") == 3).cast("int")).alias("y")).join(maps, "r", "left")


_DENSE = "ev AS (SELECT event_id // 4 AS r, event_type, value FROM events), n AS (SELECT r, event_type, sum(floor(value) - 30) FILTER (NOT isnan(value)) AS v FROM ev GROUP BY ALL), s AS (SELECT r, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS y FROM ev GROUP BY 1), ty AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{k}')" for i, k in enumerate(_KINDS)) + ") v(k, event_type)), dn AS (SELECT r, k, coalesce(v, 0) AS x, y FROM s CROSS JOIN ty LEFT JOIN n USING (r, event_type))"
_CUTS = {i + 1: [-40.0, -10.0, 0.0, 15.0, 60.0] for i in range(len(_KINDS))}


@query(f"WITH {_DENSE} SELECT k::INT AS feature, len(list_filter([{', '.join(map(str, _CUTS[1]))}]::DOUBLE[], lambda v: v + 1e-11 <= x))::INT AS bin, sum(0.5 - y)::DOUBLE AS g, sum(0.25)::DOUBLE AS h, count(*) AS n FROM dn GROUP BY ALL")
def sparse_histogram(spark, d):
    """Histogram of sparse rows; zeros are a node's totals less what is stored."""
    return summaries.sparse_histogram(_sparse_rows(spark, d), "x", _CUTS, 0.5 - F.col("y"), F.lit(0.25)).drop("node")


@query(f"WITH {_DENSE} SELECT k::INT AS feature, count(*) AS n, count(*) FILTER (x <> 0) AS stored, 0::BIGINT AS missing, min(x) AS lo, max(x) AS hi FROM dn GROUP BY k HAVING count(*) FILTER (x <> 0) > 0")
def sparse_summaries(spark, d):
    return summaries.sparse_summarised(_sparse_rows(spark, d), "x").drop("sketch")


@query(f"WITH {_DENSE}, o AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) AS r, count(*) OVER (PARTITION BY k) AS n FROM dn WHERE k IN (SELECT k FROM dn WHERE x <> 0)) SELECT k::INT AS feature, z.q::DOUBLE AS q, x AS value FROM o, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q) z WHERE r = greatest(1, ceil(z.q::DOUBLE * n))")
def sparse_quantiles(spark, d):
    """Quantiles of sparse rows from sketches that hold all of these tables' values (so they are exact here) and the mass at 0."""
    s = summaries.sparse_summarised(_sparse_rows(spark, d), "x", error=0.0002)
    return s.select("feature", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), summaries.quantile(q).alias("value")) for q in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("z")).select("feature", "z.*")


@query(f"WITH {_DENSE} SELECT r, sum(b)::BIGINT AS total FROM (SELECT r, len(list_filter([{', '.join(map(str, _CUTS[1][:-1]))}]::DOUBLE[], lambda v: v < x)) AS b FROM dn) GROUP BY 1")
def sparse_to_bins(spark, d):
    """Stored values become right-closed bins; a row's bins are summed, those of implied zeros too."""
    zeros = summaries.zero_bins(_CUTS)
    bins = summaries.sparse_converted(_sparse_rows(spark, d), "x", _CUTS)
    held = F.aggregate(F.map_values(F.coalesce("x", F.create_map().cast("map<int,double>"))), F.lit(0.0), lambda s, v: s + v)
    implied = sum((F.when(F.coalesce(F.map_contains_key("x", F.lit(k)), F.lit(False)), 0).otherwise(z) for k, z in zeros.items()), F.lit(0))
    return bins.select("r", (held + implied).cast("long").alias("total"))


# --- binning, supervised bins ----------------------------------------------------------------------------------------
@query(f"WITH {_T}, {_U}, {_C}, {_B} SELECT feature, bin::INT AS bin, count(*) AS n FROM b GROUP BY ALL")
def bin_digitize(spark, d):
    return _hist(spark, d)[0].select("feature", "bin", "n")


_POINTS = [10.0, 20.0, 30.0, 40.0, 50.0]


@query(f"SELECT ({' + '.join(f'(CASE WHEN {p} < l_quantity THEN 1 ELSE 0 END)' for p in _POINTS[:-1])})::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def bin_bisect(spark, d):
    return _train(spark, d).groupBy(binning.bisect_left(F.col("l_quantity"), _POINTS).alias("bin")).agg(F.count("*").alias("n"))


def _woe(spark, d):
    bins = binning.bisect_left(F.col("l_quantity"), _POINTS)
    return binning.event_counts(_train(spark, d), "l_quantity", bins)


_COUNTS = f"WITH n AS (SELECT ({' + '.join(f'(CASE WHEN {p} < l_quantity THEN 1 ELSE 0 END)' for p in _POINTS[:-1])})::INT AS bin, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS events, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END)::BIGINT AS others FROM lineitem GROUP BY 1)"


@query(f"{_COUNTS} SELECT 'l_quantity' AS feature, bin, events, others FROM n")
def bin_event_counts(spark, d):
    return _woe(spark, d)


@query(f"{_COUNTS}, r AS (SELECT bin, events, others, CASE WHEN events = 0 OR others = 0 THEN (events + 0.5::DOUBLE) / greatest(sum(events) OVER (), 1) ELSE events / greatest(sum(events) OVER (), 1) END AS e, CASE WHEN events = 0 OR others = 0 THEN (others + 0.5::DOUBLE) / greatest(sum(others) OVER (), 1) ELSE others / greatest(sum(others) OVER (), 1) END AS o FROM n) SELECT 'l_quantity' AS feature, bin, round(ln(e / o), 6) AS woe, round(sum((e - o) * ln(e / o)) OVER (), 8) AS iv FROM r")
def woe_iv(spark, d):
    return binning.woe_iv(_woe(spark, d)).select("feature", "bin", F.round("woe", 6).alias("woe"), F.round("iv", 8).alias("iv"))


@query(f"{_COUNTS}, r AS (SELECT bin, round(ln((events / sum(events) OVER ()) / (others / sum(others) OVER ())), 6) AS woe FROM n), x AS (SELECT l_orderkey, l_linenumber, ({' + '.join(f'(CASE WHEN {p} < l_quantity THEN 1 ELSE 0 END)' for p in _POINTS[:-1])})::INT AS bin FROM lineitem) SELECT l_orderkey, l_linenumber, woe AS l_quantity FROM x JOIN r USING (bin)")
def woe_convert(spark, d):
    """Rows with their bin's weight of evidence in place of the value."""
    woe = binning.woe_iv(_woe(spark, d)).select("feature", "bin", F.round("woe", 6).alias("woe"))
    return binning.converted(_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), {"l_quantity": _POINTS}, woe)


@query("SELECT 'n_chars' AS feature, ((CASE WHEN 500 < n_chars THEN 1 ELSE 0 END) + (CASE WHEN 1000 < n_chars THEN 1 ELSE 0 END) + (CASE WHEN 2000 < n_chars THEN 1 ELSE 0 END))::INT AS bin, sum(quality)::BIGINT AS events, sum(1 - quality)::BIGINT AS others FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def joined_event_counts(spark, d):
    """Labels of another table, joined by key."""
    bins = binning.bisect_left(F.col("n_chars"), [500.0, 1000.0, 2000.0, 4000.0])
    return binning.joined_counts(_table(spark, d, "documents").select("doc_id", "n_chars"), _table(spark, d, "labels"), "doc_id", "n_chars", bins, "quality")


def _bucket_bins(spark, d) -> feature_bins.BinResult:
    p = feature_bins.BinParams(method="bucket", bin_num=8, bin_names=["l_quantity", "l_extendedprice"], category_names=["l_tax"], transform_names=["l_quantity", "l_tax"], transform_type="woe", abnormal=[7.0])
    return feature_bins.fit_bins(_train(spark, d), "y", p)


_BUCKETS = """WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <> 7 THEN l_quantity END::DOUBLE AS q, CASE WHEN l_extendedprice <> 7 THEN l_extendedprice END::DOUBLE AS e, l_tax::DOUBLE AS x, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
u AS (SELECT 'l_quantity' AS feature, q AS v, y FROM v UNION ALL SELECT 'l_extendedprice', e, y FROM v), m AS (SELECT feature, min(v) AS lo, (max(v) - min(v)) / 8 AS st, max(v) AS hi FROM u GROUP BY 1),
p AS (SELECT feature, i::INT AS bin, CASE WHEN i = 7 THEN hi ELSE lo + (i + 1) * st END AS point FROM m, range(8) r(i) UNION ALL SELECT 'l_tax', (row_number() OVER (ORDER BY x) - 1)::INT, x FROM (SELECT DISTINCT x FROM v)),
ps AS (SELECT feature, list(point ORDER BY bin) AS ps FROM p GROUP BY 1), z AS (SELECT * FROM u UNION ALL SELECT 'l_tax', x, y FROM v),
c AS (SELECT feature, len(list_filter(ps[1 : len(ps) - 1], lambda t: t < v))::INT AS bin, sum(y)::BIGINT AS events, sum(1 - y)::BIGINT AS others FROM z JOIN ps USING (feature) WHERE v IS NOT NULL GROUP BY ALL),
r AS (SELECT *, CASE WHEN events = 0 OR others = 0 THEN 0.5::DOUBLE ELSE 0 END AS adj, greatest(sum(events) OVER (PARTITION BY feature), 1) AS te, greatest(sum(others) OVER (PARTITION BY feature), 1) AS tn FROM c),
w AS (SELECT *, ln(((events + adj) / te) / ((others + adj) / tn)) AS woe, ((events + adj) / te - (others + adj) / tn) * ln(((events + adj) / te) / ((others + adj) / tn)) AS iv_bin FROM r)"""


@query(f"{_BUCKETS}, s AS (SELECT *, woe - lag(woe) OVER (PARTITION BY feature ORDER BY bin) AS st FROM w) SELECT feature, bin, round(point, 6) AS point, events, others, round(events / te, 8) AS event_rate, round(others / tn, 8) AS other_rate, round(woe, 6) AS woe, round(sum(iv_bin) OVER (PARTITION BY feature), 8) AS iv, (count(*) FILTER (st > 0) OVER (PARTITION BY feature) = 0 OR count(*) FILTER (st < 0) OVER (PARTITION BY feature) = 0) AS monotonic FROM s JOIN p USING (feature, bin)")
def feature_bins_table(spark, d):
    """Bins of two columns and a category, with their weights."""
    names = {"point": 6, "event_rate": 8, "other_rate": 8, "woe": 6, "iv": 8}
    return _bucket_bins(spark, d).table.drop("iv_bin").withColumns({c: F.round(c, k) for c, k in names.items()})


@query(f"{_BUCKETS} SELECT round(avg(CASE WHEN q IS NULL THEN 7 ELSE (SELECT woe FROM w WHERE feature = 'l_quantity' AND bin = qb) END), 6) AS quantity, round(avg((SELECT woe FROM w WHERE feature = 'l_tax' AND bin = xb)), 6) AS tax FROM (SELECT q, len(list_filter((SELECT ps[1 : len(ps) - 1] FROM ps WHERE feature = 'l_quantity'), lambda t: t < q)) AS qb, len(list_filter((SELECT ps[1 : len(ps) - 1] FROM ps WHERE feature = 'l_tax'), lambda t: t < x)) AS xb FROM v)")
def feature_bins_transform(spark, d):
    """Rows with the weights of their bins in place of two columns, abnormal values left as they are: the means."""
    rows = _bucket_bins(spark, d).transform(_train(spark, d))
    return rows.agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_tax"), 6).alias("tax"))


@query("SELECT event_id, CAST(value AS FLOAT) AS value FROM events")
def to_float32(spark, d):
    return _table(spark, d, "events").select("event_id", F.col("value").cast("float").alias("value"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP::DATE AS day, len(list_filter([5.0, 10.0, 20.0, 50.0, 100.0]::DOUBLE[], lambda v: v + 1e-11 <= value))::INT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL")
def windowed_bin_counts(spark, d):
    """The streaming aggregate of bins by window, over the table as it stands."""
    w = histograms.windowed_bins(_table(spark, d, "events"), "ts", "value", [5.0, 10.0, 20.0, 50.0, 100.0], "1 day")
    return w.select(F.to_date("start").alias("day"), "bin", "n")


@query(f"{_COUNTS} SELECT 'l_quantity' AS feature, events, others, true AS gapless FROM n")
def anonymous_bins(spark, d):
    """Counts of bins whose numbers tell nothing of the values behind them, but still go from 0 up."""
    shuffled = binning.shuffled_bins(_woe(spark, d), 5)
    w = binning.Window.partitionBy("feature")  # five bins
    return shuffled.withColumn("gapless", (F.min("bin").over(w) == 0) & (F.max("bin").over(w) == F.count("*").over(w) - 1) & (F.size(F.collect_set("bin").over(w)) == F.count("*").over(w))).select("feature", "events", "others", "gapless")


# --- growth ----------------------------------------------------------------------------------------------------------
@query(f"{_BASE} SELECT feature, bin::INT AS bin, g, h, n FROM h")
def root_histogram(spark, d):
    return _hist(spark, d)[0].drop("node")


def _scored(spark, d, **kw):
    hist, _ = _hist(spark, d)
    return binning.scores(hist, [Q] * 4, **kw)


@query(f"{_BASE}, {_sql_scores()} SELECT feature, cand::INT AS cand, gl, hl, gr, hr, round(score, 6) AS score FROM s")
def split_score_all(spark, d):
    return _scored(spark, d).drop("node", "gn", "hn").withColumn("score", F.round("score", 6))


_BEST = "SELECT feature, cand::INT AS cand, gl, hl, gr, hr, score FROM s ORDER BY score DESC, feature, cand LIMIT 1"


@query(f"{_BASE}, {_sql_scores()} {_BEST}")
def best_split_root(spark, d):
    """The flagship: candidates, bins, root histogram, scores, the best of them."""
    return binning.best(_scored(spark, d)).drop("node", "gn", "hn")


@query(f"{_BASE}, {_sql_scores(alpha=1, delta=0.5)} {_BEST}")
def best_split_l1_delta(spark, d):
    return binning.best(_scored(spark, d, alpha=1.0, delta=0.5)).drop("node", "gn", "hn")


@query(f"{_BASE}, {_sql_scores()} {_BEST}")
def best_split_onesided(spark, d):
    """Without noise or gaps the mean of the totals is each feature's total."""
    return binning.best(_scored(spark, d, estimator="one-sided")).drop("node", "gn", "hn")


def _model(spark, d, **kw):
    p = trees.Params(**({"num_trees": 1, "max_depth": 2} | kw))
    return trees.fit(_train(spark, d), FEATURES, "y", params=p)


@query(f"""{_BASE}, {_sql_scores()}, r AS (SELECT s.feature, k.v FROM s JOIN k USING (feature, cand) ORDER BY s.score DESC, s.feature, s.cand LIMIT 1)
SELECT CASE WHEN CASE r.feature WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END <= r.v THEN 1 ELSE 2 END AS num, count(*) AS n, sum(0.5 - y)::DOUBLE AS g, sum(0.25)::DOUBLE AS h FROM t, r GROUP BY 1""")
def node_partition_counts(spark, d):
    """Rows, gradients and hessians of the root's children."""
    m = _model(spark, d, max_depth=1)
    df = _train(spark, d)
    g, h = _first_step(df)
    return df.groupBy(trees.tree_leaf(m.trees[0][0], FEATURES).alias("num")).agg(F.count("*").alias("n"), F.sum(g).alias("g"), F.sum(h).alias("h"))


@query(f"""{_BASE}, {_sql_scores()}, r AS (SELECT s.feature, k.v FROM s JOIN k USING (feature, cand) ORDER BY s.score DESC, s.feature, s.cand LIMIT 1),
l AS (SELECT CASE WHEN CASE r.feature WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END <= r.v THEN 1 ELSE 2 END AS num, sum(0.5 - y)::DOUBLE AS g, sum(0.25)::DOUBLE AS h FROM t, r GROUP BY 1)
SELECT num, round(0.3 * greatest(-2.0, least(2.0, -g / (h + 1))), 8) AS value FROM l""")
def leaf_weights(spark, d):
    m = _model(spark, d, max_depth=1)
    return m.table(spark).where("feature is null").select("num", F.round("value", 8).alias("value"))


@query(f"""{_BASE}, {_sql_scores()}, r AS (SELECT s.feature, k.v FROM s JOIN k USING (feature, cand) ORDER BY s.score DESC, s.feature, s.cand LIMIT 1),
w AS (SELECT CASE WHEN CASE r.feature WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END <= r.v THEN 1 ELSE 2 END AS num, * EXCLUDE (feature, v) FROM t, r),
wu AS ({' UNION ALL '.join(f'SELECT num, {j} AS feature, f{j} AS x, y FROM w' for j in range(4))})
SELECT num AS node, wu.feature, len(list_filter(vs, lambda v: v + 1e-11 <= x))::INT AS bin, sum(0.5 - y)::DOUBLE AS g, sum(0.25)::DOUBLE AS h, count(*) AS n FROM wu JOIN ks USING (feature) GROUP BY ALL""")
def level2_histogram(spark, d):
    """Histograms of both children of the root, in one aggregate."""
    m = _model(spark, d, max_depth=1)
    df = _train(spark, d)
    return binning.histogram(df, m.cands, *_first_step(df), trees.tree_leaf(m.trees[0][0], FEATURES))


@query(f"{_sql_trees(3)} {_NODES}")
def tree_depth3_nodes(spark, d):
    """Nodes of a whole tree."""
    return _nodes(spark, _model(spark, d, max_depth=3))


@query(f"{_sql_trees(3, estimator='one-sided')} {_NODES}")
def tree_node_based(spark, d):
    """Candidates asked one by one: the right child is the rest of its node's sums."""
    return _nodes(spark, _model(spark, d, max_depth=3, split_method="node_based"))


@query(f"{_sql_trees(3, estimator='one-sided')} {_NODES}")
def tree_one_sided(spark, d):
    return _nodes(spark, _model(spark, d, max_depth=3, hist_estimator_method="one-sided"))


@query(f"{_sql_trees(3, estimator='two_sided')} {_NODES}")
def tree_two_sided(spark, d):
    return _nodes(spark, _model(spark, d, max_depth=3, hist_estimator_method="two_sided"))


@query(f"{_sql_trees(3, estimator='two_sided_averaging')} {_NODES}")
def tree_two_sided_averaging(spark, d):
    return _nodes(spark, _model(spark, d, max_depth=3, hist_estimator_method="two_sided_averaging"))


@query(f"{_BASE}, n AS (SELECT sum(y)::DOUBLE AS g, count(*)::DOUBLE AS h FROM t) SELECT CASE WHEN h <= 0 THEN 0.5 WHEN g <= 0 THEN 0.0 ELSE least(g / h, 1.0) END AS value FROM n")
def rf_leaf_weights(spark, d):
    s = _train(spark, d).agg(F.sum("y").cast("double").alias("g"), F.count("*").cast("double").alias("h"))
    return s.select(forest_value(F.col("g"), F.col("h")).alias("value"))


@query(f"{_sql_trees(3, 3)} {_NODES}")
def boosting_trees(spark, d):
    """Three boosted trees of depth 3."""
    return _nodes(spark, _model(spark, d, num_trees=3, max_depth=3))


@query()
def totally_random_forest(spark, d):
    return _model(spark, d, num_trees=4, max_depth=3, split_method="totally_random", training_method="rf").table(spark)


@query()
def batched_boosting(spark, d):
    return _model(spark, d, num_trees=5, max_depth=3, split_method="totally_random", training_method="batched_boosting", batched_update_size=2).table(spark)


def _sql_forest(n: int, depth: int) -> str:
    """Trees of a forest, each on its chunk of the orders' keys."""
    chunk = f"('0x' || substr(md5(l_orderkey::VARCHAR), 1, 7))::BIGINT % {n}"
    out = [f"{_T.replace('FROM lineitem', f', l_orderkey, l_linenumber, {chunk} AS chunk FROM lineitem')}, {_U}, {_C}", "r AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM t)"]
    for t in range(n):
        out.append(f"g{t} AS MATERIALIZED (SELECT rid, f0, f1, f2, f3, y::DOUBLE AS g, 1.0::DOUBLE AS h FROM r WHERE chunk = {t})")
        out += _sql_tree(f"p{t}_", f"g{t}", depth)
    value = "CASE WHEN feature IS NOT NULL THEN NULL WHEN h <= 0 THEN 0.5 WHEN g <= 0 THEN 0.0 ELSE least(g / h, 1.0) END AS value"
    return "WITH " + ", ".join(out) + f", nodes AS ({' UNION ALL '.join(f'SELECT 0 AS class_id, {t} AS tree_id, * REPLACE ({value}) FROM p{t}_n' for t in range(n))})"


def _forest(spark, d, n: int, depth: int) -> trees.Model:
    p = trees.Params(num_trees=n, max_depth=depth, training_method="rf", row_sample_method="disjoint", subsample=1 / n)
    return trees.fit(_table(spark, d, "lineitem").select(*FEATURES, "l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("y")), FEATURES, "y", "l_orderkey", p)


@query(f"{_sql_forest(4, 3)} {_NODES}")
def histogram_forest(spark, d):
    """Four trees on disjoint chunks of the rows, grown side by side: one aggregate a level."""
    return _nodes(spark, _forest(spark, d, 4, 3))


@query(f"{_sql_trees(3)}, x AS (SELECT kind, level, direction, rounds, bytes FROM (SELECT 'candidates' AS kind, 0 AS level, 'sent' AS direction, 1 AS rounds, 8 * (SELECT count(*) FROM k) AS bytes UNION ALL SELECT 'histogram', depth, 'sent', 1, 16 * {4 * (Q + 1)} * count(*) FROM nodes WHERE depth < 3 GROUP BY depth UNION ALL SELECT 'splits', depth, 'received', 1, 16 * count(*) FROM nodes WHERE feature IS NOT NULL GROUP BY depth)) SELECT kind, level::INT AS level, direction, rounds::BIGINT AS rounds, bytes::BIGINT AS bytes FROM x")
def communication_log(spark, d):
    """What growing a tree told, as it was written down while growing."""
    return _model(spark, d, max_depth=3).told(spark).select("kind", "level", "direction", "rounds", "bytes")


@query(f"{_sql_trees(2, 3)}, e AS (SELECT tree_id, 'sent' AS direction, count(DISTINCT depth) AS rounds, 16 * {4 * (Q + 1)} * count(*) AS bytes FROM nodes WHERE depth < 2 GROUP BY tree_id UNION ALL SELECT tree_id, 'received', count(DISTINCT depth), 16 * count(*) FROM nodes WHERE feature IS NOT NULL GROUP BY tree_id) SELECT direction, " + ", ".join(f"avg({c})::DOUBLE AS avg_{c}, round(stddev_pop({c}), 6) AS std_{c}, min({c})::BIGINT AS min_{c}, max({c})::BIGINT AS max_{c}, sum({c})::BIGINT AS total_{c}" for c in ("rounds", "bytes")) + " FROM e GROUP BY direction")
def communication_stats(spark, d):
    """Mean, deviation, least, most and sum of rounds and bytes over three boosted trees, by direction."""
    log = _model(spark, d, num_trees=3, max_depth=2).told(spark)
    return trees.told_stats(log).withColumns({f"std_{c}": F.round(f"std_{c}", 6) for c in ("rounds", "bytes")})


@query(f"{_sql_trees(3)} SELECT feature::INT AS feature, depth::INT AS depth, round(sum(gain), 5) AS gain, round(sum(h), 6) AS cover, count(*) AS splits FROM nodes WHERE feature IS NOT NULL GROUP BY ALL")
def feature_importance_by_depth(spark, d):
    return _model(spark, d, max_depth=3).importance_by_depth(spark).withColumns({"gain": F.round("gain", 5), "cover": F.round("cover", 6)})


def _sql_parts(n: int, depth: int, rounds: int, out: str) -> str:
    """Boosted trees on each of ``n`` parts of the orders' keys: the nodes of part i in nodes{i}."""
    chunk = f"('0x' || substr(md5(l_orderkey::VARCHAR), 1, 7))::BIGINT % {n}"
    ctes = [f"{_T.replace('FROM lineitem', f', {chunk} AS part FROM lineitem')}, {_U.replace('y FROM t', 'y, part FROM t')}"]
    for i in range(n):
        names = {"ks": f"ks{i}", "k": f"k{i}"}
        ctes.append(f"u{i} AS (SELECT * FROM u WHERE part = {i}), " + _C.replace("c AS (", f"c{i} AS (").replace("FROM u ", f"FROM u{i} ").replace(", k AS (", f", k{i} AS (").replace("FROM c,", f"FROM c{i},").replace(", ks AS (", f", ks{i} AS (").replace("FROM k ", f"FROM k{i} "))
        for cte in _sql_boosted(["y"], depth, rounds):
            cte = cte.replace("FROM t)", f"FROM t WHERE part = {i})")
            for a in ("ks", "k"):
                cte = cte.replace(f"JOIN {a} ", f"JOIN {names[a]} ").replace(f"FROM {a})", f"FROM {names[a]})")
            for a in ("q0_", "g0_", "x0_"):
                cte = cte.replace(a, f"{a[0]}{i}p_")
            cte = cte.replace("FROM r JOIN", f"FROM r{i} JOIN").replace("rid, 0.0::DOUBLE AS m FROM r)", f"rid, 0.0::DOUBLE AS m FROM r{i})")
            ctes.append(cte.replace("SELECT r.*", f"SELECT r{i}.*").replace("r AS MATERIALIZED (SELECT row", f"r{i} AS MATERIALIZED (SELECT row").replace("nodes AS (", f"nodes{i} AS ("))
    return "WITH " + ", ".join(ctes) + " " + out


@query(_sql_parts(2, 2, 2, " UNION ALL ".join(f"SELECT {i} AS part, {_NODES[7:].replace('FROM nodes', f'FROM nodes{i}')}" for i in range(2))))
def retrained_on_halves(spark, d):
    """Boosting that stops early on one half of the orders, and as many trees on the other; scoring averages both."""
    df = _table(spark, d, "lineitem").select(*FEATURES, "l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    p = trees.Params(num_trees=5, max_depth=2, early_stopping="average_retrain", es_threshold=1e9, es_window=1)
    first, second = trees.fit(df, FEATURES, "y", "l_orderkey", p).parts
    both = [_nodes(spark, m).withColumn("part", F.lit(i)) for i, m in enumerate((first, second))]
    return both[0].unionByName(both[1])


_MULTI = _T.replace("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "ascii(l_returnflag) % 3 AS y")


@query(f"WITH {_MULTI}, {_U}, {_C}, " + ", ".join(_sql_boosted([f"(CASE WHEN y = {c} THEN 1 ELSE 0 END)" for c in range(3)], 2)) + f" {_NODES}")
def multiclass_one_vs_rest(spark, d):
    df = _table(spark, d, "lineitem").select(*FEATURES, (F.ascii("l_returnflag") % 3).alias("y"))
    return _nodes(spark, trees.fit(df, FEATURES, "y", params=trees.Params(num_trees=1, max_depth=2)))


@query(f"WITH t AS (SELECT l_quantity AS f0, l_discount AS f1, l_extendedprice / 50000 AS y FROM lineitem), u AS (SELECT 0 AS feature, f0 AS x, y FROM t UNION ALL SELECT 1, f1, y FROM t), {_C}, " + ", ".join(_sql_boosted(["y"], 3, base="greatest(-20.0::DOUBLE, least(20.0::DOUBLE, m - y)) AS g, 1.0::DOUBLE AS h", n=2)) + f" {_NODES.replace('round(g, 6)', 'round(g, 4)').replace('round(gain, 5)', 'round(gain, 3)')}")
def regression_first_tree(spark, d):
    df = _table(spark, d, "lineitem").select("l_quantity", "l_discount", (F.col("l_extendedprice") / 50000).alias("y"))
    m = trees.fit(df, ["l_quantity", "l_discount"], "y", params=trees.Params(num_trees=1, max_depth=3, task="regression"))
    return _nodes(spark, m).withColumns({"g": F.round("g", 4) + F.lit(0.0), "gain": F.round("gain", 3) + F.lit(0.0)})


# --- noise and budgets -----------------------------------------------------------------------------------------------
@query(f"{_BASE}, f AS (SELECT j::INT AS feature, b::INT AS bin FROM range(4) x(j), range({Q + 1}) z(b)) SELECT f.feature, f.bin, coalesce(g, 0.0) AS g, coalesce(h.h, 0.0) AS h, coalesce(n, 0) AS n FROM f LEFT JOIN h ON f.feature = h.feature AND f.bin = h.bin")
def histogram_noise_zero(spark, d):
    """All cells, empty ones too, with noise of deviation 0."""
    hist, _ = _hist(spark, d)
    return binning.noisy(binning.dense(hist, [Q] * 4), 0.0, 0.0, 1).drop("node")


@query()
def histogram_gaussian(spark, d):
    hist, _ = _hist(spark, d)
    sigma = privacy.sigma_for(1.0, 8, 1e-5)
    return binning.noisy(binning.dense(hist, [Q] * 4), sigma, sigma / 4, 1).drop("node")


@query()
def private_trees(spark, d):
    """Two trees under a central budget of epsilon 1."""
    return _model(spark, d, num_trees=2, max_depth=3, **{k: v for k, v in trees.PRESETS["hist_newton"].items() if k != "max_depth"}).table(spark)


@query(f"WITH {_T} SELECT round(avg(0.5 - y), 6)::DOUBLE AS mean, true AS near, true AS perturbed FROM t")
def mean_mechanism_gradients(spark, d):
    """Gradients as rows report them by the hybrid mechanism: their mean is near the true one, though hardly a report equals its gradient."""
    df = _train(spark, d).select("y", F.monotonically_increasing_id().alias("_key")).withColumns({"g": 0.5 - F.col("y"), "h": F.lit(0.25)})
    account = privacy.Accountant(epsilon=8.0, num_trees=2)
    told = trees._perturbed(df, trees.Params(dp_method="mean_mech_ldp"), account, "0/0/0").withColumn("own", 0.5 - F.col("y"))
    s = told.agg(F.avg("own").alias("mean"), F.avg("g").alias("m"), F.stddev("g").alias("s"), F.count("*").alias("n"), F.avg((F.abs(F.col("g") - F.col("own")) < 1e-9).cast("double")).alias("same"))
    return s.select(F.round("mean", 6).alias("mean"), (F.abs(F.col("m") - F.col("mean")) < 6 * F.col("s") / F.sqrt("n")).alias("near"), (F.col("same") < 0.5).alias("perturbed"))


@query()
def local_noise_trees(spark, d):
    """Trees of random structure whose rows report with Gaussian noise."""
    return _model(spark, d, num_trees=2, **{k: v for k, v in trees.PRESETS["ldp_tr"].items()} | {"max_depth": 3, "epsilon": 8.0}).table(spark)


@query()
def mean_mechanism_trees(spark, d):
    """Two trees whose rows report by the hybrid mechanism; sums are tested against the plain run's."""
    return _model(spark, d, num_trees=2, max_depth=3, dp_method="mean_mech_ldp", epsilon=8.0).table(spark)


_ORDERS = "[" + ", ".join(f"{a}::DOUBLE" for a in privacy.ORDERS) + "]"


@query(f"SELECT user_id, a AS ord, round(n * a / (2 * 40.0 * 40.0), 10) AS rdp FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), (SELECT unnest({_ORDERS}) AS a)")
def rdp_curve(spark, d):
    """Each user's Renyi curve, where every event is a Gaussian query about its user."""
    n = _table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("ord"), F.lit(r).alias("one")) for a, r in zip(privacy.ORDERS, privacy.rdp(40.0, 1))])).alias("o")
    return n.select("user_id", "n", each).select("user_id", "o.ord", F.round(F.col("n") * F.col("o.one"), 10).alias("rdp"))


@query(f"SELECT user_id, round(greatest(0, min(a * n / (2 * 40.0 * 40.0) + ln(1 - 1 / a) - ln(1e-5 * a) / (a - 1))), 6) AS epsilon FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), (SELECT unnest({_ORDERS}) AS a) GROUP BY user_id")
def epsilon_by_user(spark, d):
    """What those queries spent on each user."""
    n = _table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.round(privacy.epsilon_column(F.col("n") / (2 * 40.0 * 40.0), 1e-5), 6).alias("epsilon"))


#: Rows of the training table, by which delta is 1 / n.
_N = "n AS (SELECT count(*)::DOUBLE AS rows FROM lineitem)"


def _delta(spark, d) -> float:
    return 1 / _table(spark, d, "lineitem").count()


@query(f"WITH o AS (SELECT unnest({_ORDERS}) AS a), {_N}, q AS (SELECT epsilon, queries, 1 / rows AS delta FROM (VALUES (1.0, 600), (1.0, 100), (0.5, 100), (0.1, 50)) v(epsilon, queries), n), c AS (SELECT *, ln(1 - 1 / a) - ln(delta * a) / (a - 1) AS cost FROM q, o) SELECT epsilon::DOUBLE AS epsilon, queries::INT AS queries, round(min(sqrt(queries * a / (2 * (epsilon::DOUBLE - cost)))), 6) AS sigma FROM c WHERE epsilon > cost GROUP BY epsilon, queries, delta")
def sigma_closed_form(spark, d):
    """Noise of runs over the training table, delta being one over its rows."""
    delta, grid = _delta(spark, d), [(1.0, 600), (1.0, 100), (0.5, 100), (0.1, 50)]
    return spark.createDataFrame([(e, q, round(privacy.sigma_for(e, q, delta), 6)) for e, q in grid], "epsilon double, queries int, sigma double")


@query(f"WITH {_N}, o AS (SELECT unnest({_ORDERS}) AS a), c AS (SELECT a, ln(1 - 1 / a) - ln(a / rows) / (a - 1) AS cost FROM o, n), s AS (SELECT min(sqrt(12 * a / (2 * (1 - cost)))) AS sigma FROM c WHERE cost < 1) SELECT t::INT AS tree, l::INT AS level, kind, round(ts / 3 * ks, 8) AS share, round(sigma / sqrt(ts * 2 * ks * 2), 6) AS sigma FROM (VALUES (0, 0.7::DOUBLE), (1, 0.3::DOUBLE)) a(t, ts), range(3) b(l), (VALUES ('gradient', 0.6::DOUBLE), ('hessian', 0.4::DOUBLE)) k(kind, ks), s")
def budget_allocation(spark, d):
    """Shares and noise of trees, levels and kinds of queries, as a run over the training table draws them."""
    account = privacy.Accountant(1.0, _delta(spark, d), num_trees=2, max_depth=3, tree_budgets=(0.7, 0.3), gradient_budgets=(0.6, 0.4))
    return account.table(spark).select("tree", "level", "kind", F.round("share", 8).alias("share"), F.round("sigma", 6).alias("sigma"))


@query(f"WITH {_N} SELECT 'basic' AS method, round(100 * sqrt(2 * ln(1.25 * 100 * rows)), 6) AS sigma FROM n UNION ALL SELECT 'advanced', round(sqrt(2 * ln(1.25 * 2 * 100 * rows)) / (1 / (2 * sqrt(2 * 100 * ln(2 * 100 * rows)))), 6) FROM n")
def composition_basic(spark, d):
    """Noise of a hundred queries of the training table by basic and by advanced composition."""
    delta = _delta(spark, d)
    return spark.createDataFrame([(m, round(privacy.sigma_by(m, 1.0, delta, 100), 6)) for m in ("basic", "advanced")], "method string, sigma double")


def _sql_spent() -> str:
    cost = "(ln(1 - 1 / a) - ln(a / rows) / (a - 1))"
    return f"WITH {_N}, o AS (SELECT unnest({_ORDERS}) AS a, rows FROM n), q AS (SELECT * FROM (VALUES (1.0::DOUBLE, 600), (0.5::DOUBLE, 100)) v(epsilon, n)), s AS (SELECT epsilon, n, min(sqrt(n * a / (2 * (epsilon - {cost})))) AS sigma FROM q, o WHERE epsilon > {cost} GROUP BY ALL) SELECT epsilon, n::INT AS queries, round(min(n * a / (2 * sigma * sigma) + {cost}), 6) AS spent FROM s, o GROUP BY ALL"


@query(_sql_spent())
def composition_check(spark, d):
    """What all queries of a run over the training table spend together, composed again."""
    delta = _delta(spark, d)
    runs = [privacy.Accountant(1.0, delta, 15, 5, features_per_tree=4), privacy.Accountant(0.5, delta, 10, 5, features_per_tree=1)]
    return spark.createDataFrame([(a.epsilon, a.queries(), round(a.check(), 6)) for a in runs], "epsilon double, queries int, spent double")


@query("SELECT l_orderkey, sum(CASE WHEN l_quantity <= 25 THEN 3 ELSE 2 END * 8)::BIGINT AS queries FROM lineitem GROUP BY 1")
def ledger_counts(spark, d):
    """Queries that each order's rows took part in while a tree was grown: two for every feature at every node examined."""
    return trees.ledger(_table(spark, d, "lineitem"), _stump(), "l_orderkey", privacy.Accountant(features_per_tree=4)).select("l_orderkey", "queries")


_COST = "(ln(1 - 1 / a) - ln(1e-5 * a) / (a - 1))"


@query(f"{_sql_forest(2, 2)}, q AS (SELECT l_orderkey, 8 * count(*) AS queries FROM ({' UNION ALL '.join(f'SELECT rid FROM p{t}_w{depth}' for t in range(2) for depth in range(2))}) JOIN r USING (rid) GROUP BY 1), o AS (SELECT unnest({_ORDERS}) AS a), s AS (SELECT min(sqrt(16 * a / (2 * (1 - {_COST})))) AS sigma FROM o WHERE 1 > {_COST}), z AS (SELECT l_orderkey, queries, queries / (2 * sigma * sigma) AS rho FROM q, s) SELECT l_orderkey, queries::BIGINT AS queries, round(rho, 8) AS rho, round(greatest(0, min(a * rho + {_COST})), 6) AS epsilon FROM z, o GROUP BY l_orderkey, queries, rho")
def privacy_ledger(spark, d):
    """What each order's rows spent in a forest whose trees see disjoint chunks of the orders: queries, rho and epsilon."""
    account = privacy.Accountant(1.0, 1e-5, 2, 2, features_per_tree=4, sample="disjoint", subsample=0.5)
    spent = trees.ledger(_table(spark, d, "lineitem"), _forest(spark, d, 2, 2), "l_orderkey", account)
    return spent.select("l_orderkey", "queries", F.round("rho", 8).alias("rho"), F.round("epsilon", 6).alias("epsilon"))


@query()
def composed_epsilon(spark, d):
    """The epsilon that each quantile may have, where one is asked of every type of event; tested against the theorem's condition."""
    e = _table(spark, d, "events").agg(F.count_distinct("event_type").alias("k"), F.count("*").alias("n")).first()
    return spark.createDataFrame([(k, private_quantiles.composed_epsilon(1.0, 1 / e["n"], k)) for k in (1, e["k"], 2 * e["k"])], "k int, epsilon double")


# --- scoring and metrics ---------------------------------------------------------------------------------------------
_STUMP = "CASE WHEN l_quantity <= 25 THEN CASE WHEN l_discount <= 0.05 THEN -0.4::DOUBLE ELSE 0.1::DOUBLE END ELSE 0.3::DOUBLE END"


def _stump() -> trees.Model:
    n = trees.Node
    t = {(0, 1): n(0, 1, 0, 0, 0, 25.0), (1, 1): n(1, 1, 0, 0, 2, 0.05), (1, 2): n(1, 2, 0, 0, value=0.3), (2, 1): n(2, 1, 0, 0, value=-0.4), (2, 2): n(2, 2, 0, 0, value=0.1)}
    return trees.Model(FEATURES, trees.Params(), {0: [t]})


@query(f"SELECT l_orderkey, l_linenumber, {_STUMP} AS margin FROM lineitem")
def score_margin(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _stump().margin().alias("margin"))


@query(f"SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-({_STUMP}))), 6) AS p, CASE WHEN {_STUMP} > 0 THEN 1 ELSE 0 END AS prediction FROM lineitem")
def score_proba_class(spark, d):
    s = _stump().score(_table(spark, d, "lineitem"))
    return s.select("l_orderkey", "l_linenumber", F.round(F.col("probabilities")[1], 6).alias("p"), "prediction")


@query(f"SELECT round(avg(exp(a) / (exp(a) + exp(2 * a) + exp(-a))), 8) AS p0 FROM (SELECT {_STUMP} AS a FROM lineitem)")
def ovr_softmax(spark, d):
    m = _stump().margin()
    return _table(spark, d, "lineitem").agg(F.round(F.avg(softmax(F.array(m, 2 * m, -m))[0]), 8).alias("p0"))


@query(f"SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS loss FROM (SELECT 1 / (1 + exp(-({_STUMP}))) AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)")
def score_log_loss(spark, d):
    return _train(spark, d).agg(F.round(F.avg(log_loss(F.col("y"), _stump().margin())), 8).alias("loss"))


@query(f"{_sql_trees(3)} SELECT feature::INT AS feature, round(sum(gain), 5) AS gain, round(sum(h), 6) AS cover, count(*) AS splits, round(avg(gain), 5) AS average_gain, round(avg(h), 6) AS average_cover FROM nodes WHERE feature IS NOT NULL GROUP BY 1")
def feature_importance(spark, d):
    names = {"gain": 5, "cover": 6, "average_gain": 5, "average_cover": 6}
    return _model(spark, d, max_depth=3).importance(spark).withColumns({c: F.round(c, k) for c, k in names.items()})


@query(f"{_sql_trees(3)}, z AS (SELECT class_id, tree_id, depth, count(*) AS n FROM nodes WHERE feature IS NOT NULL GROUP BY ALL) SELECT class_id::INT AS class_id, tree_id::INT AS tree_id, count(*) AS rounds, (sum(n) * 16 * {4 * (Q + 1)})::BIGINT AS bytes FROM z GROUP BY ALL")
def communication_cost(spark, d):
    return _model(spark, d, max_depth=3).communication(spark)


@query(f"{_sql_trees(3, 3)}, e AS (" + " UNION ALL ".join(f"SELECT {k} AS trees, m AS s, y FROM x0_{k} JOIN r USING (rid)" for k in (1, 2, 3)) + "), d AS (SELECT trees, s, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM e GROUP BY ALL), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY trees ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d) SELECT trees::INT AS trees, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM w GROUP BY trees")
def staged_auc(spark, d):
    """The area under the ROC curve of each prefix of the trees, in one aggregate over (prefix, score)."""
    m = _model(spark, d, num_trees=3, max_depth=3)
    prefixes = F.explode(F.array(*[F.struct(F.lit(k).alias("trees"), m.margin(first=k).alias("score")) for k in (1, 2, 3)])).alias("s")
    return metrics.auc(_train(spark, d).select("y", prefixes).select("y", "s.*"), keys=["trees"]).withColumn("auc", F.round("auc", 6))


def _scored_rows(spark, d):
    return _train(spark, d).select("y", F.col("l_quantity").alias("score"), (F.col("l_quantity") > 25).cast("int").alias("prediction"))


_SY = "x AS (SELECT l_quantity AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), d AS (SELECT s, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM x GROUP BY s)"


@query(f"WITH {_SY}, w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 8) AS auc FROM w")
def metric_auc(spark, d):
    return metrics.auc(_scored_rows(spark, d)).select(F.round("auc", 8).alias("auc"))


@query(f"WITH {_SY}, w AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(p + n) OVER (ORDER BY s DESC) AS al FROM d) SELECT round(sum(p * tp / al) / sum(p), 8) AS ap FROM w")
def metric_average_precision(spark, d):
    return metrics.average_precision(_scored_rows(spark, d)).select(F.round("ap", 8).alias("ap"))


@query(f"WITH {_SY} SELECT s AS score, (sum(n) OVER (ORDER BY s DESC))::BIGINT AS fp, (sum(p) OVER (ORDER BY s DESC))::BIGINT AS tp FROM d")
def roc_curve(spark, d):
    return metrics.roc(_scored_rows(spark, d))


@query(f"WITH {_SY}, z AS (SELECT count(*) FILTER (s > 25 AND y = 1) AS tp, count(*) FILTER (s > 25 AND y = 0) AS fp, count(*) FILTER (s <= 25 AND y = 1) AS fn, count(*) AS a, count(*) FILTER ((s > 25) = (y = 1)) AS r FROM x) SELECT round(r / a, 8) AS accuracy, round(tp / (tp + fp), 8) AS prec, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM z")
def metric_f1_acc(spark, d):
    c = metrics.confusion(_scored_rows(spark, d)).withColumnRenamed("precision", "prec")
    return c.select(*[F.round(x, 8).alias(x) for x in ("accuracy", "prec", "recall", "f1")])


@query(f"WITH x AS (SELECT ascii(l_returnflag) % 3 AS y, [l_quantity, l_discount, l_tax] AS s FROM lineitem), e AS (SELECT c::INT AS c, s[c + 1] AS s, CASE WHEN y = c THEN 1 ELSE 0 END AS y FROM x, range(3) r(c)), d AS (SELECT c, s, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM e GROUP BY ALL), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d) SELECT c AS class, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 8) AS auc FROM w GROUP BY c")
def metric_class_auc(spark, d):
    """Each class against the rest."""
    df = _table(spark, d, "lineitem").select((F.ascii("l_returnflag") % 3).alias("y"), F.array("l_quantity", "l_discount", "l_tax").alias("s"))
    return metrics.class_auc(df, "y", "s", 3).withColumn("auc", F.round("auc", 8))


@query("WITH x AS (SELECT l_returnflag AS y, CASE WHEN l_quantity <= 10 THEN 'A' WHEN l_quantity <= 30 THEN 'N' ELSE 'R' END AS p FROM lineitem), c AS (SELECT y AS class, count(*) AS support, count(*) FILTER (y = p) AS hits FROM x GROUP BY 1), t AS (SELECT p AS class, count(*) AS told FROM x GROUP BY 1) SELECT class, round(hits / told, 8) AS prec, round(hits / support, 8) AS recall, round(2 * hits / (told + support), 8) AS f1, support FROM c JOIN t USING (class)")
def metric_report(spark, d):
    q = F.col("l_quantity")
    df = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(q <= 10, "A").when(q <= 30, "N").otherwise("R").alias("prediction"))
    r = metrics.report(df).withColumnRenamed("precision", "prec")
    return r.select("class", *[F.round(c, 8).alias(c) for c in ("prec", "recall", "f1")], "support")


@query("WITH x AS (SELECT ascii(l_returnflag) % 3 AS y, exp(l_tax) AS a, exp(l_discount) AS b, 1.0::DOUBLE AS c FROM lineitem) SELECT round(sum(a / (a + b + c) - CASE WHEN y = 0 THEN 1 ELSE 0 END), 4) AS g0, round(sum(b / (a + b + c) * (1 - b / (a + b + c))), 4) AS h1 FROM x")
def softmax_gradients(spark, d):
    df = _table(spark, d, "lineitem").select((F.ascii("l_returnflag") % 3).alias("y"), F.array("l_tax", "l_discount", F.lit(0.0)).alias("m"))
    g, h = softmax_cross_entropy(F.col("y"), F.col("m"))
    return df.agg(F.round(F.sum(g[0]), 4).alias("g0"), F.round(F.sum(h[1]), 4).alias("h1"))


@query("SELECT round(avg(power(l_extendedprice - 1000 * l_quantity, 2)) / 1e6, 4) AS mse FROM lineitem")
def metric_mse(spark, d):
    df = _table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (1000 * F.col("l_quantity")).alias("prediction"))
    return metrics.regression(df).select(F.round(F.col("mse") / 1e6, 4).alias("mse"))


# --- private quantiles -----------------------------------------------------------------------------------------------
_QS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query(f"WITH {_E}, o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM e), q AS (SELECT unnest([{', '.join(f'{q}::DOUBLE' for q in _QS)}]) AS q) SELECT q, x AS value FROM q JOIN o ON i = floor((n - 1) * q)")
def quantile_lower(spark, d):
    return private_quantiles.lower_quantiles(_events(spark, d), "value", _QS)


@query("WITH e AS (SELECT least(floor((least(greatest(value, 0), 1000) - 0) / 1000.0 * 256), 255)::BIGINT AS leaf FROM events WHERE value IS NOT NULL AND NOT isnan(value)) SELECT 1 AS level, leaf // 16 AS node, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 2, leaf, count(*) FROM e GROUP BY ALL")
def quantile_tree_counts(spark, d):
    return private_quantiles.tree_counts(_events(spark, d), "value", 0.0, 1000.0, 16, 2)


def _sql_descent() -> str:
    out = ["e AS (SELECT least(floor(least(greatest(value, 0), 1000) / 1000.0 * 65536), 65535)::BIGINT AS leaf FROM events WHERE value IS NOT NULL AND NOT isnan(value))", f"d0 AS (SELECT unnest([{', '.join(f'{q}::DOUBLE' for q in _QS)}]) AS q, 0::BIGINT AS node), a0 AS (SELECT q, node, q AS pos FROM d0)"]
    for level in range(1, 5):
        out.append(f"n{level} AS (SELECT leaf // {16 ** (4 - level)} AS node, count(*) AS n FROM e GROUP BY 1)")
        out.append(f"p{level} AS (SELECT q, pos, n{level}.node, n, sum(n) OVER (PARTITION BY q) AS total, sum(n) OVER (PARTITION BY q ORDER BY n{level}.node) AS part FROM a{level - 1} JOIN n{level} ON n{level}.node // 16 = a{level - 1}.node)")
        out.append(f"a{level} AS (SELECT q, node, least((total * pos - (part - n)) / n, 1) AS pos FROM p{level} WHERE part / total >= pos - 1e-6 QUALIFY row_number() OVER (PARTITION BY q ORDER BY node) = 1)")
    return ", ".join(out)


@query(f"WITH {_sql_descent()} SELECT q, round(node * (1000 / 65536.0::DOUBLE) + pos * (1000 / 65536.0::DOUBLE), 6) AS value FROM a4")
def quantile_tree_query(spark, d):
    """Without noise."""
    return spark.createDataFrame(list(zip(_QS, private_quantiles.quantile_tree(_events(spark, d), "value", _QS, 0.0, 1000.0))), "q double, value double").withColumn("value", F.round("value", 6))


@query()
def quantile_tree_private(spark, d):
    return spark.createDataFrame(list(zip(_QS, private_quantiles.quantile_tree(_events(spark, d), "value", _QS, 0.0, 1000.0, epsilon=1.0, seed=1))), "q double, value double")


@query()
def ind_exp(spark, d):
    return private_quantiles.ind_exp(_events(spark, d), "value", _QS, 0.0, 1000.0, 0.2)


@query()
def joint_exp_exact(spark, d):
    """All quantiles at once over the gaps between all values; weights are tested against brute force."""
    return spark.createDataFrame(list(zip(_QS, joint_quantiles.joint_exp(_events(spark, d), "value", _QS, 0.0, 1000.0, 1.0))), "q double, value double")


@query()
def joint_exp(spark, d):
    """On a histogram of equal cells."""
    return spark.createDataFrame(list(zip(_QS, private_quantiles.joint_exp(_events(spark, d), "value", _QS, 0.0, 1000.0, 1.0, 512))), "q double, value double")


def _values(spark, values) -> DataFrame:
    return spark.createDataFrame(list(zip(_QS, map(float, values))), "q double, value double")


@query()
def smooth_quantiles(spark, d):
    """Laplace noise of smooth sensitivity, which is tested against all pairs."""
    return _values(spark, private_quantiles.smooth(_events(spark, d), "value", _QS, 0.0, 1000.0, 0.2, 1e-6))


@query()
def csmooth_quantiles(spark, d):
    """Under concentrated privacy, with smoothing parameters tuned for the column."""
    e = _events(spark, d)
    return _values(spark, private_quantiles.csmooth(e, "value", _QS, 0.0, 1000.0, 0.5, private_quantiles.tuned_ts(e, "value", _QS, 0.0, 1000.0, 0.5, steps=5)))


@query()
def agg_tree_quantiles(spark, d):
    """Noisy counts made consistent."""
    return _values(spark, private_quantiles.agg_tree(_events(spark, d), "value", _QS, 0.0, 1000.0, 1.0))


@query()
def quantile_comparison(spark, d):
    """Errors of four private methods over twenty trials, each on half of the rows."""
    q, lo, hi = private_quantiles, 0.0, 1000.0
    counts = q.trial_counts(_events(spark, d), "value", "event_id", lo, hi, 20, 0.5)
    methods = {"ind_exp": lambda c, qs: q.trials_ind_exp(c, qs, lo, hi, 0.2), "joint_exp": lambda c, qs: q.trials_joint(c, qs, lo, hi, 1.0), "tree": lambda c, qs: q.trials_tree(c, qs, lo, hi, 1.0), "agg_tree": lambda c, qs: q.trials_tree(c, qs, lo, hi, 1.0, consistent=True)}
    return q.compare(counts, _QS, methods)


@query(f"WITH {_E}, o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM e), q AS (SELECT unnest([{', '.join(f'{q}::DOUBLE' for q in _QS)}]) AS q), t AS (SELECT q, x AS truth, 1000 * q AS value FROM q JOIN o ON i = floor((n - 1) * q)), b AS (SELECT count(*) AS rows FROM e JOIN t ON x > least(truth, value) AND x <= greatest(truth, value)) SELECT 'uniform' AS method, trial::INT AS trial, (SELECT rows FROM b) / 5 AS misclassified, round((SELECT avg(abs(value - truth)) FROM t), 6) AS distance FROM range(3) r(trial)")
def quantile_errors(spark, d):
    """Both errors of a method that knows the bounds alone, over three trials of all rows."""
    q = private_quantiles
    counts = q.trial_counts(_events(spark, d), "value", "event_id", 0.0, 1000.0, 3)
    guess = lambda c, qs: q._told(c, [(t, x, 1000 * x) for t in range(3) for x in qs])
    return q.compare(counts, _QS, {"uniform": guess}).withColumn("distance", F.round("distance", 6))


@query("SELECT (abs(count(*) FILTER (value > 10) - count(*) FILTER (value > 20)) + abs(count(*) FILTER (value > 30) - count(*) FILTER (value > 30.5))) / 2 AS error FROM events")
def misclassified_points(spark, d):
    return spark.createDataFrame([(private_quantiles.misclassified(_events(spark, d), "value", [(10.0, 20.0), (30.0, 30.5)]),)], "error double")


# --- local privacy ---------------------------------------------------------------------------------------------------
@query()
def local_hashing(spark, d):
    e = _events(spark, d)
    return local_privacy.hash_estimates(local_privacy.hash_reports(e, "event_id", "event_type", 2.0), e.select("event_type").distinct(), "event_type", 2.0)


@query()
def hybrid_mean(spark, d):
    x = F.least(F.greatest(F.col("value") / 500 - 1, F.lit(-1.0)), F.lit(1.0))
    return _events(spark, d).agg(F.avg(local_privacy.bounded_report(x, "event_id", 2.0)).alias("estimate"), F.avg(x).alias("mean"))


@query()
def square_wave_density(spark, d):
    x = F.least(F.greatest(F.col("value") / 1000, F.lit(0.0)), F.lit(1.0))
    reports = _events(spark, d).select(local_privacy.square_wave_report(x, "event_id", 2.0).alias("r"))
    return spark.createDataFrame(list(enumerate(local_privacy.square_wave_density(reports, "r", 2.0, bins=64))), "cell int, share double")


_W = "w AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) * 1.4 - 0.1 AS f FROM events GROUP BY 1)"


def _freq(spark, d):
    e = _events(spark, d)
    n = e.count()
    return e.groupBy("event_type").agg((F.count("*") / n * 1.4 - 0.1).alias("f"))


@query(f"WITH {_W}, r AS (SELECT f, (sum(f) OVER (ORDER BY f DESC) - 1) / row_number() OVER (ORDER BY f DESC) AS s FROM w), c AS (SELECT arg_min(s, f) AS s FROM r WHERE f > s) SELECT event_type, round(greatest(f - s, 0), 8) AS p FROM w, c")
def simplex_projection(spark, d):
    return local_privacy.to_simplex(_freq(spark, d), "f", "p").select("event_type", F.round("p", 8).alias("p"))


@query(f"WITH {_W} SELECT event_type, round(f + (1 - sum(f) OVER ()) / count(*) OVER (), 8) AS p FROM w")
def additive_norm(spark, d):
    return local_privacy.add_evenly(_freq(spark, d), "f", "p", 1.0).select("event_type", F.round("p", 8).alias("p"))


@query(f"WITH {_W} SELECT event_type, round(CASE WHEN sum(f) OVER (ORDER BY f DESC) <= 0.8 AND f > 0 THEN f ELSE 0 END, 8) AS p FROM w")
def threshold_cut(spark, d):
    return local_privacy.cut_threshold(_freq(spark, d), "f", "p", 0.8).select("event_type", F.round("p", 8).alias("p"))


# --- result analytics: orders stand for results (dataset: status, method: priority, trees: month) -----------------------
_R = "r AS (SELECT o_orderkey, o_orderstatus AS dataset, o_orderpriority AS method, month(o_orderdate)::INT AS trees, o_totalprice AS score FROM orders)"


def _results(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("method"), F.month("o_orderdate").alias("trees"), F.col("o_totalprice").alias("score"))


@query("SELECT event_id, 'gbm' AS a, (event_id % 7)::VARCHAR AS b, 'inf' AS c FROM events")
def args_parse(spark, d):
    df = _events(spark, d).select("event_id", F.format_string("{'update': 'gbm', 'bins': %d}", F.col("event_id") % 7).alias("args"))
    return df.select("event_id", analytics.setting("args", "update", "xgboost").alias("a"), analytics.setting("args", "bins", "32").alias("b"), analytics.setting("args", "rounds", "inf").alias("c"))


@query(f"WITH {_R} SELECT dataset, method, round(avg(score), 2) AS mean, round(stddev_samp(score), 2) AS std, count(*) AS n FROM r GROUP BY ALL")
def mean_std_by_method(spark, d):
    return analytics.mean_std(_results(spark, d), ["dataset", "method"], "score", 2)


@query(f"WITH {_R}, m AS (SELECT dataset, method, round(avg(score), 2) AS mean FROM r GROUP BY ALL) SELECT dataset, method, mean, mean = max(mean) OVER (PARTITION BY dataset) AS best FROM m")
def max_of_means(spark, d):
    means = analytics.mean_std(_results(spark, d), ["dataset", "method"], "score", 2).drop("std", "n")
    return analytics.flag_best(means, ["dataset"])


@query(f"WITH {_R}, m AS (SELECT dataset, method, trees, avg(score) AS a FROM r GROUP BY ALL), b AS (SELECT dataset, method, trees FROM m QUALIFY row_number() OVER (PARTITION BY dataset, method ORDER BY a DESC, trees) = 1) SELECT r.* FROM r JOIN b USING (dataset, method, trees)")
def best_trees_per_method(spark, d):
    return analytics.best_setting(_results(spark, d), ["dataset", "method"], "trees", "score").select("o_orderkey", "dataset", "method", "trees", "score")


_RANK = f"WITH {_R}, m AS (SELECT dataset, method, round(avg(score), 2) AS mean FROM r GROUP BY ALL), k AS (SELECT dataset, method, rank() OVER (PARTITION BY dataset ORDER BY mean DESC) + (count(*) OVER (PARTITION BY dataset, mean) - 1) / 2 AS rk FROM m)"


def _ranked(spark, d):
    return analytics.ranks(analytics.mean_std(_results(spark, d), ["dataset", "method"], "score", 2), ["dataset"], "mean")


@query(f"{_RANK} SELECT method, avg(rk) AS mean_rank FROM k GROUP BY 1")
def rank_methods(spark, d):
    return _ranked(spark, d).groupBy("method").agg(F.avg("rank").alias("mean_rank"))


@query(f"{_RANK} SELECT method, max(rk) FILTER (dataset = 'F') AS F, max(rk) FILTER (dataset = 'O') AS O, max(rk) FILTER (dataset = 'P') AS P FROM k GROUP BY 1")
def pivot_rank(spark, d):
    return _ranked(spark, d).groupBy("method").pivot("dataset", ["F", "O", "P"]).agg(F.max("rank"))


@query("SELECT o_orderkey, 'train' AS part, o_totalprice AS auc FROM orders UNION ALL SELECT o_orderkey, 'test', o_totalprice / 2 FROM orders")
def train_test_unpivot(spark, d):
    wide = _table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("train"), (F.col("o_totalprice") / 2).alias("test"))
    return wide.unpivot("o_orderkey", ["train", "test"], "part", "auc")


@query(f"WITH {_R} SELECT dataset, trees, min(score) AS low, max(score) AS high, round(avg(score), 2) AS mid FROM r GROUP BY ALL")
def minmax_bands(spark, d):
    return analytics.bands(_results(spark, d), ["dataset", "trees"], "score").withColumn("mid", F.round("mid", 2))


@query("SELECT round(round_even(l_discount / 0.05, 0) * 0.05, 6) AS cell, count(*) AS n FROM lineitem GROUP BY 1")
def grid_round(spark, d):
    return _table(spark, d, "lineitem").groupBy(F.round(analytics.on_grid(F.col("l_discount"), 0.05), 6).alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_type AS dataset, a AS trees, b AS depth, c AS method FROM events, (VALUES ('25'), ('50')) x(a), (VALUES ('2'), ('4')) y(b), (VALUES ('tr'), ('hist')) z(c)")
def grid_cross_product(spark, d):
    """Settings for every dataset of a table."""
    datasets_ = _table(spark, d, "events").select(F.col("event_type").alias("dataset")).distinct()
    return datasets_.join(F.broadcast(analytics.grid(spark, trees=[25, 50], depth=[2, 4], method=["tr", "hist"])))  # eight settings


@query(f"{_sql_trees(2, 2)}, e AS (" + " UNION ALL ".join(f"SELECT {k} AS trees, m AS s, y FROM x0_{k} JOIN r USING (rid)" for k in (1, 2)) + "), d AS (SELECT trees, s, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM e GROUP BY ALL), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY trees ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d) SELECT trees::INT AS trees, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS test_auc, trees * 2::BIGINT + 1 AS rounds_sent FROM w GROUP BY trees")
def training_sweep(spark, d):
    """Two settings trained at the same time, a row each."""
    df, path = _train(spark, d), f"{ordering.folder(spark)}/sweep-{uuid.uuid4().hex}"
    out = sweeps.train_sweep(df, df, FEATURES, "y", None, [{"num_trees": k, "max_depth": 2} for k in (1, 2)], path, 2)
    return out.select("trees", F.round("test_auc", 6).alias("test_auc"), "rounds_sent")


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def value_remap(spark, d):
    return _table(spark, d, "orders").groupBy(analytics.remapped("o_orderstatus", {"F": "done", "O": "open"}).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT round(1 / (1 + exp(-l_tax)), 6) AS p, count(*) AS n FROM lineitem GROUP BY 1")
def sigmoid_counts(spark, d):
    return _table(spark, d, "lineitem").groupBy(F.round(sigmoid(F.col("l_tax")), 6).alias("p")).agg(F.count("*").alias("n"))


@query("SELECT round(0.3 * greatest(-2, least(2, -(l_tax * 100 - 4) / (1 + l_quantity))), 6) + 0.0 AS w, count(*) AS n FROM lineitem GROUP BY 1")
def leaf_value_column(spark, d):
    g, h = F.col("l_tax") * 100 - 4, F.col("l_quantity")
    return _table(spark, d, "lineitem").groupBy((F.round(leaf_value(g, h), 6) + F.lit(0.0)).alias("w")).agg(F.count("*").alias("n"))


@query(f"SELECT round(sum({_sql_gain('(l_tax * 100 - 4)', 'l_quantity')}), 4) AS total FROM lineitem")
def gain_column(spark, d):
    return _table(spark, d, "lineitem").agg(F.round(F.sum(gain(F.col("l_tax") * 100 - 4, F.col("l_quantity"))), 4).alias("total"))


@query(
    "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS dataset, CASE WHEN o_orderkey % 3 = 0 THEN 'DP' ELSE '' END AS dp_method, 'totally_random' AS split_method, (o_orderkey % 5 + 2)::VARCHAR AS max_depth, '100' AS num_trees, '0.5' AS epsilon,"
    " CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS ebm, CASE WHEN o_orderkey % 2 = 0 THEN 'cyclical' ELSE 'standard' END AS feature_interaction_method, CASE WHEN o_orderkey % 2 = 0 THEN '2' ELSE 'd' END AS feature_interaction_k,"
    " CASE WHEN o_orderkey % 7 = 0 THEN 'rf' ELSE 'newton' END AS weight_update, '' AS gradient_budgets, CASE WHEN o_orderkey % 7 = 0 THEN 'rf' ELSE 'boosting' END AS training_method, CASE WHEN o_orderkey % 4 = 0 THEN 'adaptive_hessian' ELSE 'uniform' END AS sketch_type,"
    " CASE WHEN o_orderkey % 4 = 0 THEN '5' ELSE 'inf' END AS sketch_rounds, 'float64' AS quantize_q, CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END AS vec_mech, CASE WHEN o_orderkey % 5 = 0 THEN 25.0 ELSE 100.0 END::DOUBLE AS batch_size, CASE WHEN o_orderkey % 5 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS batch_perc FROM orders"
)
def run_settings(spark, d):
    k = F.col("o_orderkey")
    when = lambda n, text: F.when(k % n == 0, text).otherwise("")
    parts = [
        F.concat(F.lit("{'dp_method': '"), F.when(k % 3 == 0, "gaussian_cdp").otherwise(""), F.lit("', 'split_method': 'totally_random', 'max_depth': "), k % 5 + 2, F.lit(", 'num_trees': 100, 'epsilon': 0.5")),
        when(2, ", 'ebm': True, 'feature_interaction_method': 'cyclical', 'feature_interaction_k': 2"),
        F.lit(", 'weight_update_method': 'newton'"),
        when(7, ", 'training_method': 'rf'"),
        when(4, ", 'sketch_type': 'adaptive_hessian', 'sketch_rounds': 5"),
        when(3, ", 'vector_mechanism': True"),
        when(5, ", 'batched_update_size': 25"),
        F.lit("}"),
    ]
    runs = _table(spark, d, "orders").select("o_orderkey", F.substring_index("o_orderpriority", "-", 1).alias("dataset"), F.concat(*parts).alias("args"))
    return analytics.run_columns(runs).fillna("", ["dp_method"]).drop("args")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND NOT contains(o_orderpriority, 'LOW') OR o_orderstatus = 'P' THEN 'kept' ELSE o_orderstatus END AS status FROM orders")
def conditional_overwrite(spark, d):
    where = (F.col("o_totalprice") > 200000) & ~F.col("o_orderpriority").contains("LOW") | (F.col("o_orderstatus") == "P")
    return analytics.overwritten(_table(spark, d, "orders"), "o_orderstatus", where, "kept").select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax + l_discount, 6) AS total_client_time FROM lineitem")
def timer_sums(spark, d):
    timers = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(f"l_{c}").alias(f"t_client_{c}") for c in ("quantity", "tax", "discount")], F.col("l_extendedprice").alias("t_server_price"))
    return analytics.summed(timers, "t_client_", "total_client_time").select("l_orderkey", "l_linenumber", F.round("total_client_time", 6).alias("total_client_time"))


@query("SELECT o_orderkey, round(o_totalprice / 1024 / 1024, 9) AS mib FROM orders")
def unit_scaling(spark, d):
    sizes = _table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("mib"))
    return analytics.scaled(sizes, {"mib": 2.0**-20}).withColumn("mib", F.round("mib", 9))


_CELLS = f"WITH {_R}, m AS (SELECT dataset, method, round(avg(ln(score)), 4) AS mean, round(stddev_samp(ln(score)), 4) AS std FROM r GROUP BY ALL), c AS (SELECT dataset, method, printf('%.4f', mean) || ' (' || printf('%.4f', coalesce(std, 0)) || ')' || CASE WHEN mean = max(mean) OVER (PARTITION BY dataset) THEN '*' ELSE '' END AS cell FROM m)"


@query(f"{_CELLS} SELECT method, max(cell) FILTER (dataset = 'F') AS F, max(cell) FILTER (dataset = 'O') AS O, max(cell) FILTER (dataset = 'P') AS P FROM c GROUP BY 1")
def result_cells(spark, d):
    logs = analytics.overwritten(_results(spark, d), "score", F.lit(True), F.log("score"))
    return analytics.result_table(logs, "method", "dataset", ["F", "O", "P"], "score")


@query(f"WITH {_R} SELECT dataset, method, trees, round(avg(ln(score)), 6) AS mean, round(stddev_samp(ln(score)), 6) AS sd, count(*) AS runs FROM r GROUP BY ALL")
def appendix_sweep(spark, d):
    logs = analytics.overwritten(_results(spark, d), "score", F.lit(True), F.log("score"))
    return analytics.sweep(logs, ["dataset"], "trees", "method", "score").withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query("SELECT o_orderstatus AS dataset, o_orderpriority AS method, NULL::INT AS seed, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT l_linestatus, NULL, l_linenumber::INT, count(*) FROM lineitem GROUP BY ALL")
def results_union(spark, d):
    first, second = [f"{ordering.folder(spark)}/results-{uuid.uuid4().hex}" for _ in range(2)]
    datasets.write_results(_table(spark, d, "orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("method")), first)
    datasets.write_results(_table(spark, d, "lineitem").select(F.col("l_linestatus").alias("dataset"), F.col("l_linenumber").cast("int").alias("seed")), second)
    return datasets.read_results(spark, first, second).groupBy("dataset", "method", "seed").agg(F.count("*").alias("n"))


@query("SELECT round(2 * (least(greatest(l_quantity, 5), 45) - 5) / 40 - 1, 6) + 0.0 AS x, count(*) AS n FROM lineitem GROUP BY 1")
def clip_normalise(spark, d):
    clipped = F.greatest(F.least(F.col("l_quantity"), F.lit(45.0)), F.lit(5.0))
    return _table(spark, d, "lineitem").groupBy((F.round(2 * (clipped - 5) / 40 - 1, 6) + F.lit(0.0)).alias("x")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(sum(l_extendedprice / 100), 2) AS total, min(l_extendedprice / 100) AS low FROM lineitem WHERE l_linenumber <> 3")
def quantile_scan(spark, d):
    path = f"{ordering.folder(spark)}/column-{uuid.uuid4().hex}"
    _table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 3, "none").otherwise(F.col("l_extendedprice").cast("string")).alias("v")).write.option("header", True).csv(path)
    return datasets.quantile_column(spark, path, "v", 100.0).agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"), F.min("x").alias("low"))
