"""Metrics, labels, forecasters, regression, detection, reconciliation and the entry points."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import metrics as m
from tidewater.operators import changepoints, detect, evaluation, events, forecasters, intervals, labels, linear_model, reconcile, regression, seasonality
from tidewater.plans import templates
from tidewater.plans.api import AnomalyDetector, Forecaster
from tidewater.plans.config import DetectionConfig, Evaluation, ForecastConfig, overlay
from tidewater.sources import tables

T0, DAY, HOUR = dt.datetime(2020, 1, 1), dt.timedelta(1), dt.timedelta(hours=1)


def pairs(spark, y, p, step=DAY):
    return spark.createDataFrame([(T0 + k * step, a, b) for k, (a, b) in enumerate(zip(y, p, strict=True))], "ts timestamp_ntz, actual double, forecast double")


def test_point_metrics(spark):
    r = m.evaluate(pairs(spark, [1.0, 2.0, 3.0], [0.5, 1.5, 3.5])).first()
    assert r.MAE == 0.5 and r.RMSE == 0.5 and r.Q95 == pytest.approx(0.975 / 3) and r.MAPE == pytest.approx(100 * (0.5 + 0.25 + 0.5 / 3) / 3)
    zero = m.evaluate(pairs(spark, [0.0, 1.0], [1.0, 1.0])).first()
    assert zero.MAPE is None and zero.CORR is None


def test_interval_score(spark):
    df = spark.createDataFrame([(-2.0, 0.0, 5.0)], "y double, lo double, hi double")
    assert df.select(m.interval_score(F.col("y"), F.col("lo"), F.col("hi"), 0.95).alias("s")).first().s == pytest.approx(85)


def test_valid_rows(spark):
    nan, inf = float("nan"), float("inf")
    df = pairs(spark, [1.0, nan, 2.0, inf], [nan, 2.0, 1.0, 2.0])
    assert [r.ts.day for r in m.valid_rows(df, ["actual"]).orderBy("ts").collect()] == [1, 3]
    df = pairs(spark, [nan, 2.0, nan, inf], [1.0] * 4)
    assert [r.ts.day for r in m.valid_rows(df, ["actual"], leading_only=True, keep_inf=True).orderBy("ts").collect()] == [2, 3, 4]


TRUE = [0, 0, 0, 1, 1, 1, 1, 1, 0, 0, 0, 1, 1, 1, 0, 0]
PRED = [0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0]


def flags(spark, t, p):
    return spark.createDataFrame([(T0 + k * DAY, bool(a), bool(b)) for k, (a, b) in enumerate(zip(t, p, strict=True))], "ts timestamp_ntz, is_anomaly boolean, is_anomaly_predicted boolean")


@pytest.mark.parametrize(("bias", "precision", "recall"), [("flat", 0.938, 0.817), ("front", 0.900, 0.908), ("middle", 0.958, 0.854), ("back", 0.975, 0.725)])
def test_range_scores(spark, bias, precision, recall):
    df = flags(spark, TRUE, PRED)
    assert labels.range_precision(df, alpha=0.5, bias=bias).first()[0] == pytest.approx(precision, abs=6e-4)
    assert labels.range_recall(df, alpha=0.5, bias=bias).first()[0] == pytest.approx(recall, abs=6e-4)


def test_label_metrics_and_intervals(spark):
    df = flags(spark, [0, 1, 1, 1, 0, 1, 0, 0, 0, 0], [0] * 10)
    got = [(r.start_time.day, r.end_time.day) for r in labels.label_to_intervals(df).orderBy("start_time").collect()]
    assert got == [(2, 4), (6, 6)]
    r = labels.label_metrics(df).first()
    assert (r.precision, r.recall, r.f1, r.tn) == (0.0, 0.0, 0.0, 6)
    assert labels.soft_metrics(df, 1).first().soft_f1 is None
    assert labels.label_to_intervals(flags(spark, [0] * 3, [0] * 3)).count() == 0


def test_merge_intervals(spark):
    def merged(rows, period):
        df = spark.createDataFrame(rows, "start_time timestamp_ntz, end_time timestamp_ntz")
        return [tuple(r) for r in labels.merge_intervals(df, period).orderBy("start_time").collect()]

    h = lambda a: T0 + a * HOUR
    assert merged([(h(5), h(15)), (h(10), h(20)), (h(3), h(17)), (h(5), h(13))], "1 hour") == [(h(3), h(20))]
    d = [(T0, T0 + DAY), (T0 + DAY, T0 + 2 * DAY), (T0 + 3 * DAY, T0 + 4 * DAY)]
    assert merged(d, "1 day") == [(T0, T0 + 4 * DAY)] and len(merged(d, "1 hour")) == 2
    with pytest.raises(ValueError):
        merged([(T0 + DAY, T0)], "1 day")


def test_similarity_and_lag_forecasts(spark):
    rows = [(T0 + k * DAY, float(k % 7)) for k in range(28)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, y double").withColumn("dow", F.weekday("ts"))
    future = spark.createDataFrame([(T0 + k * DAY,) for k in range(28, 42)], "ts timestamp_ntz").withColumn("dow", F.weekday("ts"))
    f = forecasters.similarity_forecast(df, future, ["dow"]).orderBy("ts").collect()
    assert [r.forecast for r in f] == [float(k % 7) for k in range(28, 42)]
    g = forecasters.lag_forecast(df, future, [1], "week").orderBy("ts").collect()
    assert [r.forecast for r in g] == [float(k % 7) for k in range(28, 42)]
    with pytest.raises(ValueError):
        forecasters.lag_forecast(df, future, [0])
    n = forecasters.null_forecast(df, future, "median").first()
    assert n.forecast_null == 3.0


def test_interval_fallbacks(spark):
    rows = [("a", float(x)) for x in (-1, 0, 1) * 5] + [("b", 5.0)]
    df = spark.createDataFrame(rows, "k string, r double")
    model = intervals.fit_intervals(df, "r", [0.1, 0.9], ["k"], "ecdf", min_rows=5)
    out = {r.k: r for r in intervals.apply_intervals(spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 10.0)], "k string, forecast double"), model, lower=9.5).collect()}
    assert out["a"].quantile_summary == out["b"].quantile_summary == out["c"].quantile_summary == [9.5, 11.0]


def test_rolling_splits():
    s = evaluation.rolling_splits(20, 3)
    assert len(s) == 4 and (s[0][0], s[0][1]) == (range(2, 8), range(8, 11)) and s[-1][1] == range(17, 20)
    s = evaluation.rolling_splits(20, 2, 4, 4, 2, expanding=True)
    assert [list(t) for _, t in s] == [[6, 7], [10, 11], [14, 15], [18, 19]] and s[0][0] == range(0, 4)
    assert len(evaluation.rolling_splits(100, 5, max_splits=3)) == 3
    assert evaluation.rolling_splits(3, 5) == [(range(0, 3), range(3, 3))]


def test_formula_and_ols(spark):
    x = np.arange(1.0, 21)
    rows = [(float(a), "u" if a % 2 else "v", float(3 + 2 * a + (5 if a % 2 == 0 else 0))) for a in x]
    df = spark.createDataFrame(rows, "a double, c string, y double")
    d = regression.design(df, "y ~ a + C(c)")
    assert d.names == ["Intercept", "a", "c[T.v]"]
    fit = regression.fit_ols(regression.gram(df, d.columns, F.col("y")))
    assert fit.beta == pytest.approx([3, 2, 5])
    full = regression.design(df, "y ~ 0 + C(c, levels=['u', 'v']) + C(c):a")
    assert full.names == ["c[u]", "c[v]", "c[T.v]:a"] or full.names == ["c[u]", "c[v]", "c[u]:a", "c[v]:a"]


def test_fits_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = 1 + x @ [2.0, 0.0, -1.0] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    cols = {"Intercept": F.lit(1.0), **{k: F.col(k) for k in "abc"}}
    g = regression.gram(df, cols, F.col("y"))
    m1 = np.column_stack([np.ones(200), x])
    assert regression.fit_ols(g).beta == pytest.approx(np.linalg.lstsq(m1, y, rcond=None)[0])
    pen = np.diag([0, 3.0, 3, 3])
    assert regression.fit_ridge(g, 3.0).beta == pytest.approx(np.linalg.solve(m1.T @ m1 + pen, m1.T @ y))
    lasso = regression.fit_lasso(g, 0.5)
    assert lasso.coefficients()["b"] == 0 and 1.3 < lasso.coefficients()["a"] < 1.7
    assert abs(regression.fit_adaptive_lasso(g, strength=0.7).coefficients()["b"]) < 1e-3
    q = regression.fit_quantile(df, cols, F.col("y"), 0.9)
    assert np.mean(y < m1 @ q.beta) == pytest.approx(0.9, abs=0.03)
    rows, stats = regression.summary(g, regression.fit_ols(g))
    assert stats["r2"] > 0.99 and rows[1]["p"] < 1e-6 and rows[2]["p"] > 1e-4
    assert regression.t_two_sided(2.0, 10) == pytest.approx(0.0734, abs=1e-4)
    boot = regression.bootstrap_coefficients(df, cols, F.col("y"), regression.fit_ols, 20)
    assert boot.groupBy("term").agg(F.avg("estimate").alias("e")).filter("term = 'a'").first().e == pytest.approx(2, abs=0.05)
    cv = regression.fit_by_name(df, cols, F.col("y"), "ridge", order=F.col("a"))
    assert cv.beta == pytest.approx([1, 2, 0, -1], abs=0.1)
    parts = regression.breakdown(df, cols, regression.fit_ols(g), {"one": "a", "two": "b|c"}).first()
    assert parts.Intercept + parts.one + parts.two == pytest.approx(float((m1 @ regression.fit_ols(g).beta)[0]))


def daily(spark, n=400, noise=1.0, jump=0.0):
    rng = np.random.default_rng(1)
    rows = [(T0 + k * DAY, float(100 + 0.1 * k + 10 * math.sin(2 * math.pi * k / 7) + (jump if k > n // 2 else 0) + rng.normal(0, noise))) for k in range(n)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, y double")


def test_linear_model(spark):
    df = daily(spark)
    spec = linear_model.ModelSpec(seasonality={"weekly": 3}, uncertainty={"quantiles": (0.05, 0.95)}, params={"alpha": 0.1})
    model = linear_model.fit_linear(df, spec)
    f = linear_model.predict_linear(model, linear_model.future_rows(spark, model, 14)).orderBy("ts").collect()
    want = [100 + 0.1 * k + 10 * math.sin(2 * math.pi * k / 7) for k in range(400, 414)]
    assert max(abs(r.forecast - w) for r, w in zip(f, want, strict=True)) < 1.5
    assert all(r.forecast_lower < r.forecast < r.forecast_upper for r in f)
    parts = linear_model.component_breakdown(model, df).first()
    assert abs(parts.seasonality) <= 11


def test_recursive_forecast(spark):
    spec = linear_model.ModelSpec(seasonality={}, autoreg={"orders": [7], "sets": [], "intervals": [(1, 7)]}, uncertainty={"quantiles": (0.1, 0.9)}, params={"alpha": 0.01})
    model = linear_model.fit_linear(daily(spark, noise=0.1), spec)
    rows = linear_model.future_rows(spark, model, 14)
    f = linear_model.predict_linear(model, rows).orderBy("ts").collect()
    want = [100 + 0.1 * k + 10 * math.sin(2 * math.pi * k / 7) for k in range(400, 414)]
    assert max(abs(r.forecast - w) for r, w in zip(f, want, strict=True)) < 4
    sim = linear_model.predict_linear(model, rows, paths=8).orderBy("ts").collect()
    again = linear_model.predict_linear(model, rows, paths=8).orderBy("ts").collect()
    assert [r.forecast for r in sim] == [r.forecast for r in again] and all(r.forecast_lower <= r.forecast_upper for r in sim)


def test_changepoints_and_shifts(spark):
    n = 500
    rows = [(T0 + k * DAY, float(k if k < 250 else 250 - 2 * (k - 250))) for k in range(n)]
    found = changepoints.trend_changepoints(spark.createDataFrame(rows, "ts timestamp_ntz, y double"), 9, 0, "7D", 0.4)
    assert any(abs((t - (T0 + 250 * DAY)).days) <= 60 for t in found)
    shifts = changepoints.level_shifts(daily(spark, jump=200.0, noise=0.5), 5.0).collect()
    assert len(shifts) == 1 and shifts[0].start_time == T0 + 201 * DAY
    assert changepoints.filter_close([(0, 1.0), (1, 3.0), (5, 2.0)], 3) == [1, 5]


def test_seasonality(spark):
    assert seasonality.infer_order(daily(spark), seasonality.COMPONENTS["weekly"], 3) == 1
    assert seasonality.auto_orders(100, ["weekly", "yearly"]) == {"weekly": 4}
    assert seasonality.drop_collinear(["sin1_toq_quarterly", "sin4_ct1_yearly", "cos5_tow_weekly"]) == ["sin4_ct1_yearly"]


def test_holidays(spark):
    assert [events.easter(y) for y in (2019, 2020, 2021, 2024)] == [dt.date(2019, 4, 21), dt.date(2020, 4, 12), dt.date(2021, 4, 4), dt.date(2024, 3, 31)]
    us = {r.event_name: r.date for r in events.holidays(spark, ["US"], 2020, 2020).collect()}
    assert us["Thanksgiving"] == dt.date(2020, 11, 26) and us["Memorial Day"] == dt.date(2020, 5, 25)
    one = spark.createDataFrame([("x", dt.date(2020, 1, 2), "event")], "event_key string, date date, event_name string")
    keys = sorted(r.event_key for r in events.expand_window(one, 1, 2).collect())
    assert keys == ["x", "x_minus_1", "x_plus_1", "x_plus_2"]


def test_detectors(spark):
    y = [10.0] * 50
    y[7] = y[30] = 25.0
    df = pairs(spark, y, [10.0 + (k % 3) * 0.1 for k in range(50)]).withColumn("is_anomaly", F.col("actual") > 20)
    d = detect.ApeDetector(detect.F1, [5, 30, 80]).fit(df)
    assert d.threshold in (5.0, 30.0) and d.predict(df).filter("is_anomaly_predicted").count() == 2
    i = detect.IntervalDetector(detect.config_reward("F1")).fit(df)
    assert i.predict(df).filter("is_anomaly_predicted").count() == 2
    none = df.drop("is_anomaly").withColumn("is_anomaly", F.lit(False))
    share = detect.IntervalDetector(detect.config_reward(None, target_percent=4.0, band=0.2)).fit(none)
    assert share.predict(none).filter("is_anomaly_predicted").count() == 2
    reward = (detect.PRECISION + 1) * 2
    assert df.withColumn("p", F.col("actual") > 20).agg(reward.column(F.col("is_anomaly"), F.col("p")).alias("r")).first().r == 4.0


@pytest.mark.parametrize("method", ["ols", "mint_sample"])
def test_reconciliation_matches_closed_form(spark, method):
    rng = np.random.default_rng(5)
    h = reconcile.Hierarchy([[2], [3, 2]])
    s = h.sum_matrix()
    actual = s @ rng.uniform(10, 20, (5, 60))
    base = actual + rng.normal(0, np.arange(1, 9)[:, None], actual.shape)
    names = [f"n{k}" for k in range(8)]
    long = lambda m: spark.createDataFrame([(t, names[i], float(m[i, t])) for i in range(8) for t in range(60)], "ts int, node string, value double")
    got = reconcile.fit_reconciler(h, names, method, long(actual), long(base)).apply(long(base))
    w = np.eye(8) if method == "ols" else (actual - base) @ (actual - base).T / 60
    wi = np.linalg.inv(w)
    want = s @ np.linalg.inv(s.T @ wi @ s) @ s.T @ wi @ base
    for r in got.collect():
        assert r.value == pytest.approx(want[int(r.node[1:]), r.ts], rel=1e-6)
    assert reconcile.violation(got, h, names).agg(F.max("violation")).first()[0] < 1e-8


def test_hierarchy():
    h = reconcile.Hierarchy([[2], [1, 2]])
    assert h.sum_matrix().tolist() == [[1, 1, 1], [1, 0, 0], [0, 1, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1]] and h.children(2) == [4, 5]
    assert not (h.constraint_matrix() @ h.sum_matrix()).any()
    cov = np.diag(np.arange(1.0, 7))
    t = reconcile.weighted_transform(h, cov, 1.0, 0.5)
    assert (h.constraint_matrix() @ t) == pytest.approx(0, abs=1e-9) and t @ h.sum_matrix() == pytest.approx(h.sum_matrix())
    with pytest.raises(ValueError):
        reconcile.Hierarchy([[2], [1]])


def test_templates_and_config():
    p = templates.parse_name("DAILY_SEAS_NM_GR_LINEAR_CP_LT_HOL_SP2_FEASET_AUTO_ALGO_RIDGE_AR_AUTO")
    assert p["seasonality"] == {"yearly": 15, "weekly": 3} and p["changepoints"]["strength"] == 0.6 and p["autoreg"]
    with pytest.raises(ValueError):
        templates.parse_name("DAILY_SEAS_XX")
    assert templates.auto_template("D", 7, 10, 7) == templates.TEMPLATES["DAILY_1"] and len(templates.auto_template("D", 7, 1, 7)) == 1
    c = ForecastConfig(horizon=3, evaluation=Evaluation(cv_max_splits=2))
    assert ForecastConfig.from_json(c.to_json()) == c
    with pytest.raises(ValueError):
        overlay({"a": 1}, {"b": 2})
    with pytest.raises(ValueError):
        ForecastConfig.from_dict({"nope": 1})


def test_model_json():
    fit = regression.Fit(["a"], np.array([1.5]), 2.0)
    back = tables.loads(tables.dumps(fit), [regression.Fit])
    assert back.names == ["a"] and back.beta.tolist() == [1.5]


def test_forecaster_end_to_end(spark):
    r = Forecaster().run(daily(spark, 200), ForecastConfig(template="DAILY_SEAS_LT_GR_LINEAR_CP_NONE_HOL_NONE_FEASET_OFF_ALGO_RIDGE_AR_OFF", horizon=7))
    assert r.forecast.count() == 7 and r.metrics["MAPE"] < 5


def test_detector_end_to_end(spark):
    df = daily(spark, 150)
    spoiled = df.withColumn("y", F.when(F.col("ts") == F.lit(T0 + 100 * DAY), 400.0).otherwise(F.col("y")))
    a = spark.createDataFrame([(T0 + 100 * DAY, T0 + 100 * DAY)], "start_time timestamp_ntz, end_time timestamp_ntz")
    cfg = ForecastConfig(template="DAILY_SEAS_LT_GR_LINEAR_CP_NONE_HOL_NONE_FEASET_OFF_ALGO_RIDGE_AR_OFF", horizon=7)
    d = AnomalyDetector(cfg, DetectionConfig()).fit(spoiled, a)
    new = spark.createDataFrame([(T0 + (150 + k) * DAY, 500.0 if k == 2 else 115.0 + 10 * math.sin(2 * math.pi * (150 + k) / 7)) for k in range(5)], "ts timestamp_ntz, y double")
    assert [r.ts.day for r in d.predict(new).filter("is_anomaly_predicted").collect()] == [(T0 + 152 * DAY).day]
