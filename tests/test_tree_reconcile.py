"""Reconciliation along a tree against dense matrices, and adaptive lasso paths against single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import changepoints, reconcile, regression, tree_reconcile

EDGES = [("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("f", "b"), ("g", "c"), ("h", "a")]
NODES, LEAVES = list("abcdefgh"), list("defgh")
BELOW = {"a": "defgh", "b": "def", "c": "g"}


def dense(w, base):
    s = np.array([[float(x in BELOW.get(n, n)) for x in LEAVES] for n in NODES])
    w = np.diag(w)
    return s @ np.linalg.solve(s.T @ w @ s, s.T @ w @ base)


@pytest.mark.parametrize("weights", ["ols", "structural", "table", "bottom_up"])
def test_tree_matches_dense_least_squares(spark, weights):
    rng = np.random.default_rng(3)
    base = rng.normal(10, 3, (8, 6))
    own = rng.uniform(0.1, 4, 8)
    w = {"ols": np.ones(8), "structural": np.array([1 / len(BELOW.get(n, n)) for n in NODES]), "table": own, "bottom_up": np.array([float(n in LEAVES) for n in NODES])}[weights]
    rows = [(t, NODES[i], float(base[i, t])) for i in range(8) for t in range(6)]
    table = spark.createDataFrame([(n, float(x)) for n, x in zip(NODES, own, strict=True)], "node string, w double")
    got = tree_reconcile.reconcile_tree(spark.createDataFrame(rows, "ts int, node string, value double"), spark.createDataFrame(EDGES, "node string, parent string"), table if weights == "table" else weights)
    want = dense(w, base)
    found = {(r.node, r.ts): r.value for r in got.collect()}
    assert len(found) == 48
    for (n, t), x in found.items():
        assert x == pytest.approx(want[NODES.index(n), t], rel=1e-9)


def test_missing_forecasts_and_bad_trees(spark):
    edges = spark.createDataFrame([*EDGES, ("a", None)], "node string, parent string")
    rows = [(1, n, 1.0) for n in LEAVES] + [(2, n, 1.0) for n in NODES if n != "d"] + [(3, n, 1.0) for n in NODES] + [(3, "other", 1.0)]
    df = spark.createDataFrame(rows, "ts int, node string, value double")
    got = {(r.ts, r.node): r.value for r in tree_reconcile.reconcile_tree(df, edges).collect()}
    assert {n: x for (t, n), x in got.items() if t == 1} == {"a": 5.0, "b": 3.0, "c": 1.0, **dict.fromkeys(LEAVES, 1.0)}
    assert all(x is None for (t, n), x in got.items() if t == 2) and (2, "a") in got and (3, "other") not in got
    assert tree_reconcile.reconcile_tree(df.limit(0), edges).count() == 0
    for bad in ([("b", "a"), ("b", "c")], [("x", "y"), ("y", "x")], [("b", "a"), ("x", "y"), ("y", "x")]):
        with pytest.raises(ValueError):
            tree_reconcile.reconcile_tree(df, spark.createDataFrame(bad, "node string, parent string"))


def test_ten_thousand_leaves(spark):
    nodes = spark.range(10_000).select(F.concat(F.lit("l"), "id").alias("node"), F.concat(F.lit("m"), F.col("id") % 100).alias("parent"))
    edges = nodes.unionByName(spark.range(100).select(F.concat(F.lit("m"), "id").alias("node"), F.lit("all").alias("parent")))
    every = edges.select("node").unionByName(spark.createDataFrame([("all",)], "node string"))
    base = every.select(F.lit(1).alias("ts"), "node", (F.pmod(F.xxhash64("node"), F.lit(100)) + 1).cast("double").alias("value"))
    got = tree_reconcile.reconcile_tree(base, edges, "structural")
    assert got.count() == 10_101
    sums = got.join(edges, "node").groupBy("ts", F.col("parent").alias("node")).agg(F.sum("value").alias("s"))
    assert sums.join(got, ["ts", "node"]).agg(F.max(F.abs(F.col("s") - F.col("value")))).first()[0] < 1e-6


def test_residual_weights(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 3.0), (1, "y", 2.0)], "ts int, node string, value double")
    f = spark.createDataFrame([(1, "x", 2.0), (2, "x", 1.0), (1, "y", 2.0)], "ts int, node string, value double")
    assert [tuple(r) for r in tree_reconcile.residual_weights(a, f).collect()] == [("x", 0.4)]


def test_adaptive_lasso_path_matches_single_fits():
    rng = np.random.default_rng(1)
    names = ["Intercept", *[f"x{k}" for k in range(6)]]
    folds = []
    for _ in range(4):
        x = np.column_stack([np.ones(80), rng.normal(size=(80, 6))])
        y = x @ np.array([2.0, 3, 0, 0, -1, 0, 0]) + rng.normal(0, 0.5, 80)
        folds.append(regression.Gram(names, x.T @ x, x.T @ y, float(y @ y), 80.0, 80))
    fit = regression.fit_adaptive_lasso_cv(folds, [0.3, 0.6, 0.9])
    total = regression.total_of(folds)
    assert np.allclose(fit.beta, regression.fit_adaptive_lasso(total, strength=fit.params["strength"]).beta)
    # single fits of each fold at the penalties of all rows
    first = regression.fit_ridge(total, 1.0).beta
    for s, loss in fit.params["losses"].items():
        lam = regression.fit_adaptive_lasso(total, first, s).alpha
        want = 0.0
        for f in folds:
            t = total - f
            rest, xx, xy, mx, my = regression._centred(t)
            w = np.abs(first[rest])
            b = regression.coordinate_descent(xx * np.outer(w, w), xy * w, np.full(6, lam), np.zeros(6)) * w
            want += regression.squared_loss(f, regression._from_centred(t, rest, b, mx, my)) / f.n
        assert loss == pytest.approx(want, rel=1e-6)
    with pytest.raises(ValueError):
        regression.fit_adaptive_lasso_cv(folds, [0.0, 0.5])


def test_changepoints_with_a_chosen_strength(spark):
    days = spark.range(1200).select(F.expr("timestamp_ntz '2015-01-01' + make_dt_interval(cast(id AS int))").alias("ts"), F.when(F.col("id") < 600, F.col("id")).otherwise(1200 - F.col("id")).cast("double").alias("y"))
    found = changepoints.trend_changepoints(days, 10, 0, "7D", None, 60)
    assert found and min(abs((t - __import__("datetime").datetime(2016, 8, 23)).days) for t in found) <= 70
