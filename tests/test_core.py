"""Contracts that SQL can't state, against plain Python and NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quercus.operators import binning, candidates, joint_quantiles, local_privacy, ordering, private_quantiles, sampling, summaries
from quercus.plans import analytics, feature_bins, privacy, sweeps, trees
from quercus.sources import datasets


def test_bins_equal_digitize(spark):
    cands = [0.0, 1.0, 2.5]
    xs = [-1.0, 0.0, 1e-12, 2e-11, 1.0, 2.4, 2.5, 2.6, float("nan"), None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r[0] for r in rows.orderBy("i").select(binning.bin_of(F.col("x"), cands)).collect()]
    edges = np.array([c + 1e-11 for c in cands])
    assert got == [int((edges <= x).sum()) if x is not None and not math.isnan(x) else None for x in xs]


def _plain_tree(x, y, cands, depth, at=0, num=1, mask=None):
    """A recursive grower over arrays: the contract of the level-wise one."""
    mask = np.ones(len(y), bool) if mask is None else mask
    g, h = (0.5 - y[mask]).sum(), 0.25 * mask.sum()
    gain = lambda a, b: (lambda w: -w * a if abs(w) <= 2 else -(2 * a * math.copysign(2, w) + (b + 1) * 4))(-a / (b + 1))
    best = (1e-7, None)
    if at < depth:
        for j in range(x.shape[1]):
            for c in cands[j]:
                left = mask & (x[:, j] < c + 1e-11)
                gl, hl = (0.5 - y[left]).sum(), 0.25 * left.sum()
                s = 0.5 * (gain(gl, hl) + gain(g - gl, h - hl) - gain(g, h))
                if s > best[0] + 1e-12:
                    best = (s, (j, c))
    if best[1] is None:
        return {(at, num): (None, None)}
    j, c = best[1]
    left = mask & (x[:, j] <= c)
    return {(at, num): (j, c)} | _plain_tree(x, y, cands, depth, at + 1, 2 * num - 1, left) | _plain_tree(x, y, cands, depth, at + 1, 2 * num, mask & ~left)


def test_tree_equals_plain_grower(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0) & (rng.random(300) > 0.1)).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, y int")
    m = trees.fit(df, ["a", "b", "c"], "y", params=trees.Params(num_trees=1, max_depth=3, hist_bin=8))
    want = _plain_tree(x, y, [m.cands[f] for f in "abc"], 3)
    got = {k: (n.feature, n.threshold) for k, n in m.trees[0][0].items()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] is None or math.isclose(v[1], want[k][1]) for k, v in got.items())


def test_missing_values_go_right(spark):
    df = spark.createDataFrame([(1.0, 0)] * 20 + [(2.0, 1)] * 20 + [(None, 1), (float("nan"), 1)], "a double, y int")
    m = trees.fit(df, ["a"], "y", params=trees.Params(num_trees=1, max_depth=1, hist_bin=4))
    leaves = {r[0]: r[1] for r in df.groupBy("a").agg(F.first(trees.tree_leaf(m.trees[0][0], ["a"]))).collect() if r[0] is None or r[0] < 3}
    assert leaves[1.0] == 1 and leaves[2.0] == 2 and leaves[None] == 2


@pytest.mark.parametrize("settings", [{}, {"training_method": "rf", "split_method": "totally_random"}, {"training_method": "batched_boosting", "batched_update_size": 2, "split_method": "totally_random"}, {"sketch_type": "adaptive_hessian"}, {"feature_interaction_method": "cyclical", "feature_interaction_k": 1}, {"row_sample_method": "poisson", "subsample": 0.7}, {"split_method": "partially_random"}, {"dp_method": "gaussian_cdp", "epsilon": 50.0, "vector_mechanism": True}, {"dp_method": "gaussian_ldp", "epsilon": 50.0}])
def test_training_methods_learn(spark, settings):
    df = datasets.synthetic(spark, 400, 3, 2, seed=3)
    m = trees.fit(df, ["f0", "f1", "f2"], "y", "row_id", trees.Params(**({"num_trees": 5, "max_depth": 3, "hist_bin": 8, "seed": 1} | settings)))
    from quercus.operators.metrics import auc

    assert auc(m.score(df).select("y", F.col("probabilities")[1].alias("score"))).first()[0] > 0.6


def test_model_survives_saving(spark, tmp_path):
    df = datasets.synthetic(spark, 200, 2, 1)
    m = trees.fit(df, ["f0", "f1"], "y", params=trees.Params(num_trees=2, max_depth=2, hist_bin=4))
    m.save(spark, f"file://{tmp_path}/m")
    again = trees.Model.load(spark, f"file://{tmp_path}/m")
    assert sorted(again.rows(), key=str) == sorted(m.rows(), key=str)


@pytest.mark.parametrize("eps, queries, delta, sigma", [(1, 600, 1e-5, 99.0913), (1, 100, 1e-5, 40.453854), (1, 200, 1e-5, 57.210389), (0.5, 100, 1 / 60000, 74.288182), (0.1, 50, 1e-5, 240.347155), (1, 12, 1e-4, 12.154212)])
def test_sigma_anchors(eps, queries, delta, sigma):
    assert privacy.sigma_for(eps, queries, delta) == pytest.approx(sigma, rel=1e-6)
    assert privacy.epsilon_of(privacy.rdp(sigma, queries), delta) == pytest.approx(eps, rel=1e-4)


def test_refined_candidates():
    assert candidates.hessian_refined([0.0, 1.0, 2.0], [0, 9, 0, 0], 9.0, 3)[0] == 1.0
    assert candidates.counted_quantiles([1, 1, 1, 1], [0, 1, 2, 3, 4], 4) == [0.0, 1.0, 2.0, 3]


def test_sketch_ranks(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    for i, v in enumerate(candidates.sketch(df, ["x"], 10)["x"]):
        assert abs(v - (i + 1) * 500) <= 10


def test_private_quantiles_near_true_ones(spark):
    df = spark.range(4000).select((F.col("id") / 4.0).alias("x"))
    qs = [0.25, 0.5, 0.75]
    assert private_quantiles.quantile_tree(df, "x", qs, 0.0, 1000.0) == pytest.approx([250, 500, 750], abs=1)
    assert private_quantiles.quantile_tree(df, "x", qs, 0.0, 1000.0, epsilon=5.0) == pytest.approx([250, 500, 750], abs=60)
    assert private_quantiles.joint_exp(df, "x", qs, 0.0, 1000.0, 5.0, 256) == pytest.approx([250, 500, 750], abs=40)
    got = sorted(r["value"] for r in private_quantiles.ind_exp(df, "x", qs, 0.0, 1000.0, 2.0).collect())
    assert got == pytest.approx([250, 500, 750], abs=20)


def test_local_reports_are_unbiased(spark):
    df = spark.range(40000).select("id", (F.col("id") % 4).alias("item"), F.lit(0.4).alias("x"))
    got = {r["item"]: r["estimate"] for r in local_privacy.hash_estimates(local_privacy.hash_reports(df, "id", "item", 2.0, seeds=50), spark.range(4).withColumnRenamed("id", "item"), "item", 2.0).collect()}
    assert all(abs(v - 10000) < 1500 for v in got.values())
    for kind in ("hybrid", "rounding", "piecewise"):
        assert df.agg(F.avg(local_privacy.bounded_report(F.col("x"), "id", 1.0, kind))).first()[0] == pytest.approx(0.4, abs=0.05)


def test_noise_has_its_deviation(spark):
    hist = spark.createDataFrame([(n, 0, b, 0.0, 0.0, 0) for n in range(60) for b in range(60)], "node int, feature int, bin int, g double, h double, n long")
    s = binning.noisy(hist, 3.0, 1.0, 7).agg(F.stddev("g"), F.stddev("h"), F.avg("g")).first()
    assert s[0] == pytest.approx(3, rel=0.1) and s[1] == pytest.approx(1, rel=0.1) and abs(s[2]) < 0.3


def test_refined_thresholds_are_private(spark):
    rows = spark.createDataFrame([(float(i % 97) ** 2, i % 2) for i in range(400)], "x double, y int")
    fit = lambda sigma: trees.fit(rows, ["x"], "y", params=trees.Params(**trees.PRESETS["dp_tr_newton_ih"] | {"num_trees": 2, "hist_bin": 8, "sigma": sigma})).cands
    assert fit(0.0) == fit(0.0) and fit(50.0) != fit(0.0)
    assert privacy.Accountant(num_trees=10, split_method="totally_random", features_per_tree=3, vector=True, sketch_rounds=5).queries() == 10 + 15


def test_hybrid_levels(spark):
    rng = np.random.default_rng(6)
    x, z = rng.random(600), rng.random(600)
    rows = spark.createDataFrame([(float(a), float(b), int(a > 0.5)) for a, b in zip(x, z)], "x double, z double, y int")
    fit = lambda levels, seed: trees.fit(rows, ["x", "z"], "y", params=trees.Params(num_trees=1, max_depth=2, hist_bin=8, split_method="hybrid_random", split_method_per_level=levels, seed=seed)).trees[0][0]
    best = trees.fit(rows, ["x", "z"], "y", params=trees.Params(num_trees=1, max_depth=1, hist_bin=8)).trees[0][0][0, 1]
    for seed in (3, 5):
        late, early = fit(["hist_based", "totally_random"], seed), fit(["totally_random", "hist_based"], seed)
        assert (late[0, 1].feature, late[0, 1].threshold) == (best.feature, best.threshold)
        assert early[0, 1].score == math.inf and all(n.score == math.inf for n in late.values() if n.depth == 1 and n.feature is not None)
        assert any(0 < n.score < math.inf for n in early.values() if n.depth == 1)
        for tree in (late, early):
            leaves = [n for n in tree.values() if n.feature is None]
            assert sum(n.h for n in leaves) == pytest.approx(150) and all(math.isfinite(n.value) for n in leaves)
    a = privacy.Accountant(num_trees=3, max_depth=3, split_method="hybrid_random", per_level=("totally_random", "hist_based", "totally_random"), features_per_tree=2)
    assert a.levels() == [0, 0.5, 0.5] and a.queries() == 3 * 2 * 2 + 2 * 3


def test_readers(spark, tmp_path):
    (tmp_path / "bank.csv").write_text("age;job;y\n30;admin;yes\n40;none;no\n30;admin;no\n")
    got = datasets.load(spark, "bank", f"file://{tmp_path}/bank.csv").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0), (0, 1, 1), (1, 0, 0)]


def test_missing_values_of_readers(spark, tmp_path):
    (tmp_path / "aps.csv").write_text("class,a,b\npos,1,na\nneg,na,2\n")
    got = datasets.load(spark, "aps", f"file://{tmp_path}/aps.csv").collect()
    assert sorted(map(tuple, got)) == [(0, -1.0, 2.0), (1, 1.0, -1.0)]
    rows = [[str(i + j) for j in range(119)] + [str(1 - 2 * (i % 2))] for i in range(3)]
    rows[1][4], rows[2][7] = "?", "word"
    (tmp_path / "nomao.csv").write_text("".join(",".join(r) + "\n" for r in rows))
    df = datasets.load(spark, "nomao", f"file://{tmp_path}/nomao.csv")
    assert df.columns == ["y", *[f"_c{j}" for j in range(119) if j not in (4, 7)]] and sorted(r["y"] for r in df.collect()) == [0, 0, 1]
    (tmp_path / "sizes.csv").write_text("v\n 250\nnone\n100\nNaN\n\n")
    assert sorted(r["x"] for r in datasets.quantile_column(spark, f"file://{tmp_path}/sizes.csv", "v", 100.0).collect()) == [1.0, 2.5]


def test_run_settings_keep_given_columns(spark):
    args = "{'dp_method': 'gaussian_cdp', 'split_method': 'hist_based', 'num_trees': 50, 'training_method': 'rf', 'batched_update_size': 10}"
    row = analytics.run_columns(spark.createDataFrame([(args, "0.1"), (None, "0.2")], "args string, epsilon string")).orderBy("epsilon").collect()
    assert (row[0]["dp_method"], row[0]["weight_update"], row[0]["batch_perc"], row[0]["epsilon"], row[0]["vec_mech"]) == ("DP", "rf", 0.2, "0.1", "False")
    assert (row[1]["dp_method"], row[1]["sketch_type"], row[1]["batch_size"], row[1]["ebm"]) == (None, "uniform", None, "False")


def test_streamed_counts_equal_batch(spark, data):
    from quercus.streaming.histograms import windowed_bins

    table = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{data}/events*.parquet")
    q = windowed_bins(stream, "ts", "value", [10.0, 50.0]).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == table.where("value is not null and not isnan(value)").count()


def test_running_sums_over_partitions(spark):
    from quercus.operators import ordering

    rng = np.random.default_rng(3)
    rows = [(int(k), float(x), int(n)) for k in range(3) for x, n in zip(rng.permutation(200), rng.integers(1, 9, 200))]
    df = spark.createDataFrame(rows, "k int, x double, n int").repartition(7)
    for down in (False, True):
        got = {(r["k"], r["x"]): (r["upto_n"], r["next"]) for r in ordering.running(df, "x", ["n"], ["k"], down, lead=True).collect()}
        for k in range(3):
            own = sorted(((x, n) for kk, x, n in rows if kk == k), reverse=down)
            for i, (x, _) in enumerate(own):
                assert got[k, x] == (sum(n for _, n in own[: i + 1]), own[i + 1][0] if i + 1 < len(own) else None)


def test_smooth_sensitivity(spark):
    rng = np.random.default_rng(2)
    values = np.sort(np.clip(rng.normal(0, 5, 400), -20, 20))
    data = private_quantiles.SmoothSensitivity(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", -20, 20)
    ends = np.concatenate([[-20], values, [20]])
    for q, t in ((0.5, 0.05), (0.1, 0.3), (0.99, 1.0)):
        k = int((len(values) - 1) * q)
        want = max(np.log(ends[j + 1] - ends[i + 1]) - t * max(j - i - 1, 0) for i in range(-1, k + 1) for j in range(k, len(values) + 1) if ends[j + 1] > ends[i + 1])
        value, got = data.log_of(k, t, reach=4)
        assert value == values[k] and got == pytest.approx(want)


def test_private_quantiles_run(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(0, 5, 2000)], "v double")
    qs = [0.25, 0.5, 0.75]
    truth = np.quantile([r[0] for r in df.collect()], qs)
    assert np.abs(np.array(private_quantiles.smooth(df, "v", qs, -50, 50, 5.0, 1e-6)) - truth).max() < 3
    ts = private_quantiles.tuned_ts(df, "v", qs, -50, 50, 2.0, steps=5)
    assert np.abs(np.array(private_quantiles.csmooth(df, "v", qs, -50, 50, 2.0, ts)) - truth).max() < 3
    assert np.abs(np.array(private_quantiles.agg_tree(df, "v", qs, -50, 50, 5.0)) - truth).max() < 1.5
    e = private_quantiles.composed_epsilon(1.0, 1e-5, 10)
    assert 0.1 <= e < 0.4


def test_sketches_that_spend(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.random(4000))], "id long, v double")
    for kind in ("dp_hist", "dp_quantiles", "ldp_hist", "ldp_quantiles"):
        p = trees.Params(sketch_type=kind, hist_bin=8, quantile_epsilon=8.0, epsilon=10.0)
        c = trees.find_candidates(df, ["v"], p, key="id")["v"]
        assert c == sorted(c) and 0 <= c[0] and c[-1] <= 1 and abs(float(np.median(c)) - 0.5) < 0.2, kind


def test_noise_of_classes_and_sketch_budget(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(a), int(a * 3)) for a in rng.random(900)], "x double, y int")
    m = trees.fit(df, ["x"], "y", params=trees.Params(num_trees=1, max_depth=1, hist_bin=4, dp_method="gaussian_cdp", sigma=50.0))
    roots = [m.trees[c][0][0, 1].g for c in range(3)]
    plain = trees.fit(df, ["x"], "y", params=trees.Params(num_trees=1, max_depth=1, hist_bin=4))
    noise = [r - plain.trees[c][0][0, 1].g for c, r in enumerate(roots)]
    assert len({round(x, 6) for x in noise}) == 3
    assert privacy.Accountant(1.0, 1e-5, 10, 4, quantile_epsilon=0.5).sigma() > privacy.Accountant(1.0, 1e-5, 10, 4).sigma()
    for a in (privacy.Accountant(1.0, 1e-5, 5, 3), privacy.Accountant(2.0, 1e-6, 4, 3, vector=True, tree_budgets=(0.4, 0.3, 0.2, 0.1)), privacy.Accountant(1.0, 1e-5, 5, 3, sample="poisson", subsample=0.2), privacy.Accountant(1.0, 1e-5, 5, 3, level_budgets=(0.5, 0.3, 0.2), gradient_budgets=(0.7, 0.3))):
        assert a.check() == pytest.approx(a.epsilon, rel=1e-6)


def test_settings_are_refused(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1)], "x double, y int")
    for bad in ({"split_method": "best"}, {"hist_estimator_method": "x"}, {"early_stopping": "majority"}, {"early_stopping": "average_retrain"}, {"dp_method": "no_such_method"}, {"training_method": "x"}, {"dp_method": "mean_mech_ldp", "sigma": 1.0}, {"weight_update_method": "signed", "dp_method": "gaussian_cdp"}, {"row_sample_method": "all"}):
        with pytest.raises(ValueError):
            trees.fit(df, ["x"], "y", params=trees.Params(**bad))


def test_updates_and_stopping(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(float(a), int(a > 0.4)) for a in rng.random(400)], "x double, y int")
    signed = trees.fit(df, ["x"], "y", params=trees.Params(num_trees=1, max_depth=2, weight_update_method="signed_newton"))
    assert {abs(n.value) for n in signed.trees[0][0].values() if n.feature is None} == {0.6}
    stopped = trees.fit(df, ["x"], "y", params=trees.Params(num_trees=6, max_depth=1, early_stopping="retry", es_threshold=1e9, es_window=1, es_metric="leaf_hess"))
    assert len(stopped.trees[0]) == 1
    assert len(trees.fit(df, ["x"], "y", params=trees.Params(num_trees=6, max_depth=1, early_stopping="standard", es_threshold=1e9, es_window=1)).trees[0]) == 2


def test_bins_and_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 9.0), (4, None)], "id int, x double")
    woe = spark.createDataFrame([("x", 0, -0.5), ("x", 2, 0.25)], "feature string, bin int, woe double")
    assert [r["x"] for r in binning.converted(df, {"x": [2.0, 6.0, 10.0]}).orderBy("id").collect()] == [0, 1, 2, None]
    assert [r["x"] for r in binning.converted(df, {"x": [2.0, 6.0, 10.0]}, woe).orderBy("id").collect()] == [-0.5, None, 0.25, None]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "id int, y int")
    got = {r["bin"]: (r["events"], r["others"]) for r in binning.joined_counts(df, labels, "id", "x", binning.bisect_left(F.col("x"), [2.0, 6.0, 10.0])).collect()}
    assert got == {0: (1, 0), 1: (0, 1), 2: (1, 0)}
    assert sorted(r["bin"] for r in binning.shuffled_bins(woe).collect()) == [0, 1]


def test_even_bins_equal_digitize(spark):
    rng = np.random.default_rng(1)
    for lo, hi, q in ((0.0, 1.0, 32), (-3.7, 1e6, 17), (1e9, 1e9 + 1, 8), (0.1, 0.1, 5), (-1e-9, 1e-9, 6), (5.0, 7.0, 1), (-1e300, 1e300, 9)):
        cands = candidates.linspace(lo, hi, q)
        edges = [c + binning.EDGE for c in cands]
        xs = [*edges, *cands, *np.nextafter(edges, -np.inf), *np.nextafter(edges, np.inf), *rng.uniform(lo, hi, 50), -math.inf, math.inf, lo - 1, hi + 1, math.nan, None]
        rows = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i int, x double")
        got = [r[0] for r in rows.orderBy("i").select(binning.bin_of(F.col("x"), cands)).collect()]
        assert got == [sum(e <= x for e in edges) if x is not None and not math.isnan(x) else None for x in xs], (lo, hi, q)


def test_summaries_of_parts_merge(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(d), float(v) if v > -2 else None, float(v) if v < 2 else math.nan) for d, v in zip(rng.integers(0, 9, 20_000), rng.normal(size=20_000))]
    df, path = spark.createDataFrame(rows, "day int, a double, b double"), f"file://{tmp_path}/s"
    error = 0.005
    for days in ((0, 1, 2, 3), (4, 5, 6, 7, 8)):  # written one after the other
        summaries.append(summaries.summarised(df.where(F.col("day").isin(*days)), ["a", "b"], ["day"], error), path)
    table = summaries.read(spark, path)
    assert table.count() == 18 and table.agg(F.sum("n") + F.sum("missing")).first()[0] == 40_000
    whole = summaries.merged(table)
    for f, values in (("a", sorted(r[1] for r in rows if r[1] is not None)), ("b", sorted(r[2] for r in rows if not math.isnan(r[2])))):
        own = whole.where(F.col("feature") == f)
        r = own.select("n", "lo", "hi", summaries.rank(0.5).alias("rank")).first()
        assert (r["n"], r["lo"], r["hi"]) == (len(values), values[0], values[-1])
        assert abs(r["rank"] - np.searchsorted(values, 0.5, "right") / len(values)) < 2 * error
        found = [t["v"] for t in summaries.thresholds(own, 20).orderBy("i").collect()]
        assert found == sorted(found) and all(abs(np.searchsorted(values, v) / len(values) - (i + 1) / 20) < 2 * error for i, v in enumerate(found))
    empty = spark.createDataFrame([(None,), (math.nan,)], "x double")
    r = summaries.summarised(empty, ["x"]).select("n", "missing", summaries.quantile(0.5).alias("q")).first()
    assert (r["n"], r["missing"], r["q"]) == (0, 2, None)
    assert summaries.split_points(empty, ["x"]) == {"x": []}


def test_streamed_summaries_equal_batch(spark, data, tmp_path):
    table = spark.read.parquet(f"{data}/events.parquet")
    day = F.window("ts", "10 days").alias("w")
    (tmp_path / "in").mkdir()
    table.repartition(4).write.mode("overwrite").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    q = summaries.summarised(stream, ["value"], [day]).writeStream.format("memory").queryName("summed").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination()
    got = {tuple(r["w"]): (r["n"], r["missing"], r["lo"], r["hi"]) for r in spark.table("summed").collect()}
    want = {tuple(r["w"]): (r["n"], r["missing"], r["lo"], r["hi"]) for r in summaries.summarised(table.withColumn("ts", F.col("ts").cast("timestamp")), ["value"], [day]).collect()}
    assert got == want
    values = np.sort([r["value"] for r in table.select("value").collect() if r["value"] is not None and not math.isnan(r["value"])])
    for i, v in enumerate(t["v"] for t in summaries.thresholds(summaries.merged(spark.table("summed")), 10).orderBy("i").collect()):
        assert abs(np.searchsorted(values, v) / len(values) - (i + 1) / 10) < 0.005


def _sparse(spark, rng, n, m=4):
    dense = [[None if rng.random() < 0.05 else float(np.round(rng.normal(), 2)) if rng.random() < 0.4 else 0.0 for _ in range(m)] for _ in range(n)]
    maps = [{j: (math.nan if v is None else v) for j, v in enumerate(r) if v != 0.0 or rng.random() < 0.1} for r in dense]  # some zeros are stored
    return dense, maps


def test_sparse_rows_equal_dense_ones(spark):
    rng = np.random.default_rng(7)
    dense, maps = _sparse(spark, rng, 600)
    df = spark.createDataFrame([(i, i % 3, float(i % 2), x if i else None) for i, x in enumerate(maps)], "i int, node int, y double, x map<int,double>")
    dense[0] = [0.0] * 4  # a null map
    columns = spark.createDataFrame([(i, i % 3, float(i % 2), *r) for i, r in enumerate(dense)], "i int, node int, y double, a double, b double, c double, d double")
    cands = {j: [-1.0, 0.0, 0.5] if j else [0.3] for j in range(4)}
    g, h = 0.5 - F.col("y"), F.lit(0.25)
    got = sorted(map(tuple, summaries.sparse_histogram(df, "x", cands, g, h, F.col("node")).select("node", "feature", "bin", "g", "h", "n").collect()))
    want = binning.histogram(columns, dict(zip("abcd", cands.values())), g, h, F.col("node")).select("node", "feature", "bin", "g", "h", "n").collect()
    assert got == sorted(map(tuple, want))
    s = {r["feature"]: r for r in summaries.sparse_summarised(df, "x").select("*", summaries.quantile([0.05, 0.3, 0.5, 0.9, 1.0]).alias("q")).collect()}
    t = {r["feature"]: r for r in summaries.summarised(columns, list("abcd")).select("*", summaries.quantile([0.05, 0.3, 0.5, 0.9, 1.0]).alias("q")).collect()}
    for j, f in enumerate("abcd"):
        assert all(s[j][c] == t[f][c] for c in ("n", "missing", "lo", "hi", "q")), (s[j], t[f])
    points = {j: [-0.5, 0.0, 0.7, 9.0] for j in (0, 2)}
    zero = summaries.zero_bins(points)
    bins = [r["x"] for r in summaries.sparse_converted(df, "x", points).orderBy("i").collect()]
    plain = binning.converted(columns, {"a": points[0], "c": points[2]}).orderBy("i").collect()
    for i, (x, r) in enumerate(zip(bins, plain)):
        for j, f in ((0, "a"), (2, "c")):
            assert (x or {}).get(j, zero[j]) == r[f]
        assert (x or {}).get(1, 0.0) == r["b"] or math.isnan(x[1]) and r["b"] is None
    weights = {j: [0.1, None, 0.3, 0.4] for j in points}
    woe = summaries.sparse_converted(df, "x", points, weights).orderBy("i").collect()
    assert all(r["x"] is None or all(v == (None if b[j] is None else weights[j][int(b[j])]) for j, v in r["x"].items() if j in points) for r, b in zip(woe, bins))


def test_zero_mass_of_many_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.create_map(F.lit(1), F.col("id") - 1500.0)).alias("x"))
    for error in (0.001, 0.01):
        r = summaries.sparse_summarised(df, "x", error=error).select("n", "stored", summaries.quantile([0.02, 0.2, 0.5, 0.98]).alias("q"), summaries.rank(0.0).alias("rank")).first()
        assert (r["n"], r["stored"]) == (3000, 299) and r["q"][1] == 0.0 and r["q"][2] == 0.0
        assert abs(r["q"][0] - -900) <= 3000 * 20 * error and abs(r["q"][3] - 890) <= 3000 * 20 * error and abs(r["rank"] - 0.95) < 2 * error + 0.002


@pytest.mark.parametrize("settings", [{}, {"row_sample_method": "poisson", "subsample": 0.6}, {"row_sample_method": "disjoint", "subsample": 0.25}, {"colsample_bytree": 0.7, "colsample_bylevel": 0.6}, {"feature_interaction_method": "cyclical", "feature_interaction_k": 1}, {"split_method": "node_based"}, {"split_method": "partially_random"}, {"split_method": "totally_random", "row_sample_method": "poisson", "subsample": 0.5}, {"split_method": "hybrid_random", "split_method_per_level": ["hist_based", "totally_random", "hist_based"]}, {"dp_method": "gaussian_cdp", "sigma": 3.0}, {"dp_method": "gaussian_cdp", "sigma": 2.0, "split_method": "node_based"}, {"colsample_bynode": 0.5}])
def test_trees_side_by_side_equal_trees_alone(spark, settings):
    df = datasets.synthetic(spark, 500, 3, 2, seed=3)
    p = trees.Params(**{"num_trees": 5, "max_depth": 3, "hist_bin": 8, "training_method": "rf", "seed": 4} | settings)
    together = trees.fit(df, ["f0", "f1", "f2"], "y", "row_id", p)
    base = df.select("f0", "f1", "f2", F.col("y").cast("double").alias("g"), F.lit(1.0).alias("h"), F.col("row_id").alias("_key"))
    account = privacy.Accountant(p.epsilon, 1 / 500, 5, 3, p.split_method, features_per_tree=p.feature_interaction_k or 3, forest=True)
    for t in range(5):
        taken = trees._taken(p, t)
        w = trees.Grower(base if taken is None else base.where(taken), ["f0", "f1", "f2"], together.cands, p, account, t, trees._columns(p, 3, t), 0, 500)
        alone = w.grow()
        assert {k: (n.feature, n.threshold, n.value) for k, n in alone.items()} == {k: (n.feature, n.threshold, n.value) for k, n in together.trees[0][t].items()}


def test_a_level_of_a_forest_is_one_aggregate(spark, monkeypatch):
    df = datasets.synthetic(spark, 300, 3, 2, seed=3)
    passes = []
    best = binning.best
    monkeypatch.setattr(trees.binning, "best", lambda scored: passes.append(1) or best(scored))
    m = trees.fit(df, ["f0", "f1", "f2"], "y", "row_id", trees.Params(num_trees=16, max_depth=3, hist_bin=8, training_method="rf", row_sample_method="poisson", subsample=0.8))
    assert len(m.trees[0]) == 16 and len(passes) == 3


def test_reports_of_rows_are_private_and_unbiased(spark):
    df = datasets.synthetic(spark, 3000, 2, 2, seed=5)
    plain = trees.fit(df, ["f0", "f1"], "y", "row_id", trees.Params(num_trees=1, max_depth=1, hist_bin=4))
    for method in ("mean_mech_ldp", "gaussian_ldp"):
        p = trees.Params(num_trees=1, max_depth=1, hist_bin=4, dp_method=method, epsilon=40.0)
        one, again = (trees.fit(df.repartition(n), ["f0", "f1"], "y", "row_id", p) for n in (2, 5))
        root, other, true = one.trees[0][0][0, 1], again.trees[0][0][0, 1], plain.trees[0][0][0, 1]
        assert root.g != true.g and root.h != true.h and abs(root.g - true.g) < 0.1 * 3000 and abs(root.h - true.h) < 0.1 * 750
        assert root.g == pytest.approx(other.g, abs=1e-6)  # draws come from keys, not from places
    unkeyed = trees.fit(df, ["f0", "f1"], "y", params=trees.Params(num_trees=1, max_depth=1, hist_bin=4, dp_method="mean_mech_ldp", epsilon=40.0))
    assert unkeyed.trees[0][0][0, 1].g != plain.trees[0][0][0, 1].g


def test_retraining_combines_models(spark, tmp_path):
    df = datasets.synthetic(spark, 900, 3, 2, seed=6)
    stop = {"num_trees": 6, "max_depth": 2, "hist_bin": 8, "es_threshold": 1e9, "es_window": 1}
    for kind, n in (("average_retrain", 2), ("majority_retrain", 3)):
        m = trees.fit(df, ["f0", "f1", "f2"], "y", "row_id", trees.Params(**stop, early_stopping=kind))
        assert len(m.parts) == n and all(len(x.trees[0]) == 2 for x in m.parts)
        own = [trees.fit(df.where(sampling.chunk("row_id", n) == i), ["f0", "f1", "f2"], "y", "row_id", trees.Params(num_trees=2, max_depth=2, hist_bin=8)) for i in range(n)]
        assert [x.rows() for x in own] == [x.rows() for x in m.parts]
        scored = m.score(df)
        for i, x in enumerate(own):
            scored = scored.withColumn(f"m{i}", x.margin())
        for r in scored.collect():
            margins = [r[f"m{i}"] for i in range(n)]
            p1 = sum(1 / (1 + math.exp(-v)) for v in margins) / n
            votes = sum(v > 0 for v in margins)
            assert r["margins"][0] == pytest.approx(sum(margins) / n) and r["probabilities"][1] == pytest.approx(p1)
            assert r["prediction"] == (int(votes > n / 2) if kind == "majority_retrain" else int(p1 > 0.5))
        m.save(spark, f"file://{tmp_path}/{kind}")
        again = trees.Model.load(spark, f"file://{tmp_path}/{kind}")
        assert [sorted(x.rows(), key=str) for x in again.parts] == [sorted(x.rows(), key=str) for x in m.parts] and again.vote == m.vote
    private = trees.fit(df, ["f0", "f1", "f2"], "y", "row_id", trees.Params(**stop, early_stopping="standard_retrain", dp_method="gaussian_cdp", epsilon=5.0))
    assert len(private.trees[0]) == 2 and 0 < private.params.epsilon < 5.0


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    where = Path(ordering.folder(spark).removeprefix("file:"))
    before = set(where.iterdir())
    trees.fit(datasets.synthetic(spark, 100, 2, 1), ["f0", "f1"], "y", params=trees.Params(num_trees=2, max_depth=1, hist_bin=4, checkpoint_every=1))
    with pytest.raises(ZeroDivisionError), ordering.scratch(spark):
        ordering.stored(spark.range(3))
        1 / 0  # noqa: B018
    assert set(where.iterdir()) == before


def test_a_sweep_goes_on_where_it_stopped(spark, tmp_path):
    ran = []

    def job(setting):
        ran.append(setting["a"])
        if setting["a"] == 3 and len(ran) < 5:
            raise RuntimeError("killed")
        return {"twice": spark.range(setting["a"]).count() * 2}

    settings, path = [{"a": a, "b": "x"} for a in range(6)], f"file://{tmp_path}/s"
    with pytest.raises(RuntimeError):
        sweeps.sweep(spark, settings, job, path, "twice long", 1)
    assert ran == [0, 1, 2, 3] and len(sweeps.committed(spark, path)) == 3
    again = sweeps.sweep(spark, settings, job, path, "twice long", 3)
    assert sorted(ran) == [0, 1, 2, 3, 3, 4, 5]
    undisturbed = sweeps.sweep(spark, settings, job, f"file://{tmp_path}/u", "twice long", 3)
    plain = lambda df: sorted((r["setting"], r["twice"]) for r in df.collect())
    assert plain(again) == plain(undisturbed) and len(plain(again)) == 6
    assert sweeps.name_of({"a": 1, "b": 2}) == sweeps.name_of({"b": 2, "a": 1})


def test_sensitivity_without_all_pairs(spark):
    rng = np.random.default_rng(12)
    for n, t in ((1, 0.1), (40, 1e-4), (700, 3e-5), (700, 0.02), (300, 2.0)):
        values = np.sort(np.minimum(np.round(rng.lognormal(1, 1, n), 1 if n != 300 else 3), 60.0))
        x = np.concatenate([[0.0], values, [60.0]])
        k = int(rng.integers(0, n))
        with np.errstate(divide="ignore"):
            i, j = np.arange(k + 2), np.arange(k + 1, n + 2)
            want = (np.log(x[None, j] - x[i, None]) - t * np.maximum(j[None, :] - i[:, None] - 1, 0)).max()
        data = private_quantiles.SmoothSensitivity(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", 0.0, 60.0)
        value, got = data.log_of(k, t, reach=8)
        assert value == values[k] and got == pytest.approx(want, rel=1e-12)


def test_spread_and_composition_are_best():
    for epsilon, t in ((1.0, 0.3), (0.2, 0.05), (2.0, 0.01)):
        s = private_quantiles.log_normal_sigma(epsilon, t)
        variance = lambda s: math.exp(5 * s * s) / (epsilon - t / s) ** 2  # noqa: E731, B023
        assert epsilon - t / s > 0 and all(variance(s) <= variance(s * (1 + d)) + 1e-12 for d in (-1e-3, 1e-3))
    for k in (2, 5, 10):
        e = private_quantiles.composed_epsilon(1.0, 1e-5, k)
        assert private_quantiles.mechanisms_delta(e, 1.0, k) <= 1e-5 < private_quantiles.mechanisms_delta(e + 1e-6, 1.0, k) and 1 / k <= e < 1
    assert private_quantiles.composed_epsilon(1.0, 1e-5, 1) == 1.0


def test_rows_of_one_history_spend_alike(spark):
    df = datasets.synthetic(spark, 600, 3, 2, seed=3).select("row_id", "f0", "f1", "f2", "y")
    for method, share in (("poisson", 0.5), ("disjoint", 0.34), ("wor", 0.5)):
        p = trees.Params(num_trees=3, max_depth=2, hist_bin=8, row_sample_method=method, subsample=share, split_method="totally_random")
        m = trees.fit(df, ["f0", "f1", "f2"], "y", "row_id", p)
        account = privacy.Accountant(1.0, 1e-5, 3, 2, split_method="totally_random", tree_budgets=(0.5, 0.3, 0.2))
        spent = {r["row_id"]: r for r in trees.ledger(df, m, "row_id", account).collect()}
        seen = {i: [] for i in spent}
        for t in range(3):
            own = sampling.without_replacement(df, "row_id", share, t) if method == "wor" else df.withColumn("_key", F.col("row_id")).where(trees._taken(p, t))
            for r in own.select("row_id").collect():
                seen[r["row_id"]].append(t)
        for i, history in seen.items():
            rho = sum(2 / (2 * account.sigma_at(t, 1, 0) ** 2) for t in history)
            curve = [rho * a + privacy._cost(a, 1e-5) for a in privacy.ORDERS]
            assert spent[i]["queries"] == 2 * len(history) and spent[i]["rho"] == pytest.approx(rho)
            assert spent[i]["epsilon"] == pytest.approx(max(0.0, min(curve)) if history else 0.0)
        assert len({tuple(h) for h in seen.values()}) > 2


def test_joint_weights_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(joint_quantiles, "PART_ROWS", 60)
    rng = np.random.default_rng(31)
    values = np.round(np.concatenate([rng.normal(5, 2, 120), rng.normal(5, 0.01, 60), [9.0] * 20]), 3)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)] * 40, "v double")
    lo, hi, n, qs, epsilon = 0.0, 10.0, 200, [0.1, 0.5, 0.52, 0.9], 1.5
    x = np.unique(np.clip(np.concatenate([[lo], values]), lo, hi))
    end = np.append(x[1:], hi)
    r = np.array([(np.clip(values, lo, hi) <= v).sum() for v in x])
    x, end, r = x[end > x], end[end > x], r[end > x]
    wanted, rate, w = np.diff([0.0, *qs]) * n, epsilon / 4, np.log(end - x)
    alphas = [(w - rate * np.abs(r - wanted[0]))[:, None]]
    for j in range(1, len(qs)):
        a = np.logaddexp.reduce(alphas[-1], axis=1)
        alone = [w[i] + np.logaddexp.reduce(np.append(a[:i] - rate * np.abs(r[i] - r[:i] - wanted[j]), -math.inf)) for i in range(len(x))]
        shared = alphas[-1] + w[:, None] - np.log(np.arange(2, j + 2))[None, :] - rate * wanted[j]
        alphas.append(np.concatenate([np.array(alone)[:, None], shared], axis=1))
    table, count = joint_quantiles.gaps(df, "v", lo, hi)
    assert count == n
    tables = joint_quantiles.forward(ordering.stored(table), n, qs, epsilon)
    assert tables[0].select("_p").distinct().count() > 1
    for want, t in zip(alphas, tables):
        got = t.orderBy("r").collect()
        assert [g["r"] for g in got] == r.tolist()
        np.testing.assert_allclose(np.array([g["alphas"] for g in got]), want, rtol=1e-9)
    draws = np.array([joint_quantiles.drawn(tables, n, qs, epsilon, s) for s in range(12)])
    assert np.abs(draws.mean(axis=0) - np.quantile(values, qs)).max() < 1.0


def test_joint_quantiles_ignore_missing_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(math.nan,)] * 300 + [(None,)] * 50, "v double")
    got = joint_quantiles.joint_exp(df, "v", [0.25, 0.5], 0.0, 100.0, 40.0)
    assert got == pytest.approx([25, 50], abs=3)
    assert private_quantiles.joint_exp(df, "v", [0.5], 0.0, 100.0, 40.0, 128) == pytest.approx([50], abs=4)
    assert len(joint_quantiles.joint_exp(df.limit(0), "v", [0.2, 0.4], 0.0, 1.0, 1.0)) == 2


def test_trials_together_equal_trials_alone(spark, monkeypatch):
    rng = np.random.default_rng(41)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.round(rng.normal(0, 5, 1500), 1))] + [(9999, math.nan)], "id long, v double")
    q, qs = private_quantiles, [0.25, 0.5, 0.9]
    counts = ordering.stored(q.trial_counts(df, "v", "id", -20, 20, 6, 0.5))
    held = {}
    for r in counts.collect():
        held.setdefault(r["trial"], []).extend([r["x"]] * r["n"])
    assert len(held) == 6 and all(600 < len(v) < 900 for v in held.values()) and len({tuple(sorted(v)) for v in held.values()}) == 6
    methods = {"ind": lambda c, qs: q.trials_ind_exp(c, qs, -20, 20, 2.0), "joint": lambda c, qs: q.trials_joint(c, qs, -20, 20, 5.0), "tree": lambda c, qs: q.trials_tree(c, qs, -20, 20, 5.0), "agg": lambda c, qs: q.trials_tree(c, qs, -20, 20, 5.0, consistent=True)}
    estimates = {m: {(r["trial"], r["q"]): r["value"] for r in f(counts, qs).collect()} for m, f in methods.items()}
    alone = q.trials_ind_exp(counts.where("trial = 4"), qs, -20, 20, 2.0).collect()
    assert {r["q"]: r["value"] for r in alone} == {k[1]: v for k, v in estimates["ind"].items() if k[0] == 4}
    for r in q.compare(counts, qs, methods).collect():
        x = np.sort(held[r["trial"]])
        truth = [x[math.floor((len(x) - 1) * p)] for p in qs]
        told = [estimates[r["method"]][r["trial"], p] for p in qs]
        assert r["distance"] == pytest.approx(np.mean(np.abs(np.array(told) - truth))) and r["distance"] < 2
        assert r["misclassified"] == pytest.approx(np.mean([((x > min(a, b)) & (x <= max(a, b))).sum() for a, b in zip(told, truth)]))
    jobs = []
    write = ordering.stored
    monkeypatch.setattr(private_quantiles, "stored", lambda d: jobs.append(1) or write(d))
    for n in (2, 8):
        jobs.append(0)
        q.compare(q.trial_counts(df, "v", "id", -20, 20, n, 0.5), qs, methods).collect()
    assert sum(jobs[: len(jobs) // 2]) == sum(jobs[len(jobs) // 2 :])


def test_columns_of_bins():
    p, header = feature_bins.BinParams, ["a", "b", "c", "d"]
    chosen = lambda **kw: feature_bins.Columns.chosen(header, p(**kw))
    assert chosen().bins == header and chosen().transform == header
    own = chosen(bin_indexes=[2, 0], bin_names=["a", "d"], category_names=["d"])
    assert (own.bins, own.categories, own.transform) == (["c", "a"], ["d"], ["c", "a", "d"])
    assert chosen(bin_names=["a", "b"], transform_indexes=[1]).transform == ["b"]
    for bad in ({"bin_indexes": [4]}, {"bin_names": ["x"]}, {"category_indexes": [-1]}, {"bin_names": ["a"], "transform_names": ["b"]}):
        with pytest.raises(ValueError):
            chosen(**bad)


def test_quantile_bins(spark):
    rng = np.random.default_rng(51)
    rows = [(float(v), int(rng.random() < 1 / (1 + math.exp(-v))), "s") for v in rng.normal(size=800)] + [(None, 1, "s"), (math.nan, 0, "s"), (-999.0, 1, "s")]
    df = spark.createDataFrame(rows, "v double, y int, name string")
    r = feature_bins.fit_bins(df, "y", feature_bins.BinParams(bin_num=4, abnormal=[-999.0], transform_type="woe", error=0.0005))
    values = np.sort([v for v, _, _ in rows if v is not None and not math.isnan(v) and v != -999])
    assert r.points["v"] == [values[199], values[399], values[599], values[799]]
    t = r.table.orderBy("bin").collect()
    assert [x["events"] + x["others"] for x in t] == [200] * 4 and all(x["monotonic"] for x in t) and sum(x["iv_bin"] for x in t) == pytest.approx(t[0]["iv"])
    woe = [x["woe"] for x in t]
    for old, new in zip(rows, [x["v"] for x in r.transform(df).collect()]):
        v = old[0]
        assert new == (None if v is None or math.isnan(v) else v if v == -999 else pytest.approx(woe[sum(p < v for p in r.points["v"][:-1])]))
    assert feature_bins.fit_bins(df, None).table is None and feature_bins.fit_bins(df.limit(0), "y").points == {"v": []}
    for bad in ({"method": "optimal"}, {"transform_type": "x"}, {"transform_type": "woe", "skip_static": True}):
        with pytest.raises(ValueError):
            feature_bins.fit_bins(df, "y", feature_bins.BinParams(**bad))


def test_subsampled_curve_at_any_order():
    for sigma, rate, order in ((1.0, 0.01, 8), (2.5, 0.3, 3), (0.7, 0.5, 20), (40.0, 0.1, 64)):
        terms = [math.lgamma(order + 1) - math.lgamma(i + 1) - math.lgamma(order - i + 1) + i * math.log(rate) + (order - i) * math.log1p(-rate) + i * (i - 1) / (2 * sigma * sigma) for i in range(order + 1)]
        want = (max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))) / (order - 1)
        assert privacy.subsampled_rdp(sigma, rate, order) == pytest.approx(want, rel=1e-6, abs=1e-12)
        near = [privacy.subsampled_rdp(sigma, rate, order + d) for d in (-0.5, 0.0, 0.5)]
        assert near[0] <= near[1] <= near[2]
    assert privacy.subsampled_rdp(3.0, 1.0, 2.5) == 2.5 / 18 and privacy.subsampled_rdp(3.0, 0.0, 2.5) == 0
