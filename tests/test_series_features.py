"""Density groups of events, lag choice, generalised linear models, rolling search: against plain numpy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import events, glm, lags, rolling_search
from tidewater.operators.linear_model import ModelSpec

T0 = dt.datetime(2022, 1, 3)


def plain_groups(scores, bandwidth=None, multiplier=0.2):
    x = np.unique(scores)
    if bandwidth is None:
        iqr = np.percentile(x, 75) - np.percentile(x, 25)
        bandwidth = 0.9 * min(x.std(), iqr / 1.34) * len(x) ** -0.2 * multiplier
    d = [sum(math.exp(-0.5 * ((a - b) / bandwidth) ** 2) for b in x) for a in x] if bandwidth else [1.0] * len(x)
    cuts = sorted({0.0, *(x[i] for i in range(1, len(x) - 1) if d[i] < d[i - 1] and d[i] < d[i + 1])})
    part = [sum(c < s for c in cuts) for s in scores]
    rank = {p: k for k, p in enumerate(sorted(set(part)))}
    return [rank[p] for p in part]


@pytest.mark.parametrize("bandwidth", [None, 0.5])
def test_events_group_at_density_valleys(spark, bandwidth):
    r = np.random.default_rng(8)
    own = {"a": np.concatenate([r.normal(m, 0.3, 12) for m in (-4, 1, 5)]), "b": r.normal(0, 1, 25), "c": np.array([2.0, 2.0, 2.0])}
    rows = [(s, f"e{k}", float(v)) for s, x in own.items() for k, v in enumerate(x)] + [("a", "none", None)]
    got = events.group_by_density(spark.createDataFrame(rows, "series string, event_key string, avg_score double"), ["series"], bandwidth).collect()
    for s, x in own.items():
        mine = {r.event_key: r.group for r in got if r.series == s}
        assert [mine[f"e{k}"] for k in range(len(x))] == plain_groups(x, bandwidth)
    assert [r.group for r in got if r.event_key == "none"] == [None]
    alone = events.group_by_density(spark.createDataFrame(rows[:36], "series string, event_key string, avg_score double").drop("series")).count()
    assert alone == 36 and events.group_by_density(spark.createDataFrame([], "event_key string, avg_score double")).count() == 0


def test_usual_lags_of_regressors():
    assert lags.auto_lagged_regressor(1, 1) == {"orders": [1], "sets": [[7, 14, 21]], "intervals": [(1, 7)]}
    assert lags.auto_lagged_regressor(1, 9) == {"orders": [14], "sets": [[14, 21, 28]], "intervals": [(9, 15)]}
    assert lags.auto_lagged_regressor(7, 3) == {"orders": [3]} and lags.auto_lagged_regressor(1, 31) is None


def test_lag_choice_finds_the_shift(spark):
    r = np.random.default_rng(2)
    rows = []
    for s, shift in (("a", 3), ("b", 5)):
        x = r.normal(size=200)
        for k in range(200):
            rows.append((s, T0 + dt.timedelta(days=k), float(2 * x[k - shift] + 0.1 * r.normal()) if k >= shift else None, float(x[k]), float(r.normal())))
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double, x double, z double")
    found = lags.lagged_correlations(df, ["x", "z"], range(1, 8), ["series"])
    assert found.count() == 2 * 2 * 7
    best = {(b.series, b.regressor): b.lag for b in lags.best_lags(found, 2, ["series"]).collect()}
    assert best["a", "x"] == 3 and best["b", "x"] == 5
    assert lags.best_lags(found, 6, ["series"]).filter("lag < 6").isEmpty()


def test_automatic_lags_reach_the_forecaster(spark):
    from tidewater.plans.api import Forecaster
    from tidewater.plans.config import Evaluation, ForecastConfig, ModelComponents

    rows = [(T0 + dt.timedelta(days=k), float(k % 7) + k / 50 if k < 100 else None, float(k % 5)) for k in range(107)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, y double, x double")
    config = ForecastConfig(template="DAILY_SEAS_LT_GR_LINEAR_CP_NONE_HOL_NONE_FEASET_OFF_ALGO_RIDGE_AR_OFF", horizon=7, evaluation=Evaluation(test_horizon=7), components=ModelComponents(lagged_regressors={"x": "auto"}))
    got = Forecaster().run(df, config)
    assert {"x_lag7", "x_avglag_7_14_21", "x_avglag_7_to_13"} <= set(got.model.names) and got.forecast.filter("forecast is not null").count() == 7


@pytest.mark.parametrize("family", ["poisson", "gamma", "binomial", "gaussian"])
def test_glm_against_newton(spark, family):
    r = np.random.default_rng(6)
    x = r.normal(size=400)
    eta = 0.3 + 0.6 * x
    y = {"poisson": r.poisson(np.exp(eta)), "gamma": r.gamma(2.0, np.exp(eta) / 2), "binomial": r.random(400) < 1 / (1 + np.exp(-eta)), "gaussian": eta + r.normal(size=400)}[family].astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (1.0, None)], "x double, y double")
    fit = glm.fit_glm(df, {"Intercept": F.lit(1.0), "x": F.col("x")}, F.col("y"), family)
    m = np.column_stack([np.ones(400), x])
    beta = np.zeros(2)
    for _ in range(200):
        e = m @ beta
        mu = {"binomial": 1 / (1 + np.exp(-e)), "gaussian": e}.get(family, np.exp(e))
        slope, var = {"poisson": (mu, mu), "gamma": (mu, mu**2), "binomial": (mu * (1 - mu), mu * (1 - mu)), "gaussian": (mu * 0 + 1, mu * 0 + 1)}[family]
        info = (m * (slope**2 / var)[:, None]).T @ m
        beta = beta + np.linalg.solve(info, m.T @ ((y - mu) * slope / var))
    phi = 1.0 if family in ("poisson", "binomial") else float(np.sum((y - mu) ** 2 / var) / 398)
    rows = glm.glm_summary(fit)
    assert fit.converged and np.allclose([q["estimate"] for q in rows], beta, rtol=1e-6)
    assert np.allclose([q["std_err"] for q in rows], np.sqrt(np.diag(np.linalg.inv(info)) * phi), rtol=1e-5)
    assert all(q["lower"] < q["estimate"] < q["upper"] and 0 <= q["p"] <= 1 for q in rows)


def test_terms_by_kind(spark):
    names = ["Intercept", "ct1", "ct1:is_weekend", "sin1_tow_weekly", "is_weekend:cos1_ct1_yearly", "events_Christmas", "y_lag7", "reg", "reg:ct1", "dow[T.2]", "changepoint0"]
    rows = glm.with_kinds(spark.createDataFrame([(n,) for n in names], "term string"), ["reg"], ["ct1", "is_weekend", "dow"])
    only = lambda **k: {r.term for r in glm.filter_terms(rows, **k).collect()}
    assert only(is_trend=True) == {"ct1", "ct1:is_weekend", "changepoint0"}
    assert only(is_regressor=True) == {"reg", "reg:ct1"} and only(is_intercept=True) == {"Intercept"} and only(is_lag=True) == {"y_lag7"}
    assert only(is_time=True, is_interaction=False) == {"ct1", "dow[T.2]"} and only(is_event=True) == {"events_Christmas"}
    assert only(is_seasonality=True) == {"sin1_tow_weekly", "is_weekend:cos1_ct1_yearly"}
    with pytest.raises(ValueError):
        glm.filter_terms(rows, is_green=True)


def test_search_over_series_with_gaps_between_train_and_test(spark):
    r = np.random.default_rng(9)
    rows = [(s, T0 + dt.timedelta(days=k), float(10 + k % 7 + (k % 2) * (s == "b") + r.normal() * 0.1)) for s, n in (("a", 70), ("b", 50), ("c", 9)) for k in range(n)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double").repartition(4)
    plain = lambda **k: ModelSpec(**{"growth": "", "seasonality": {}, "algorithm": "ols", "params": {}} | k)
    specs = [plain(extra_terms=["C(dow)"]), plain(), plain(autoreg={"orders": [1]}, upper=12.0)]
    splits = [rolling_search.Split(0, 5, 7), rolling_search.Split(5, 5, 12, 40)]
    scores = rolling_search.rolling_scores(df, specs, splits, ["series"], names=["MAE"])
    got = {(q.series, q.config, q.split): q.MAE for q in scores.collect()}
    for s in ("a", "b"):
        y = [v for name, _, v in rows if name == s]
        n = len(y)
        for j, sp in enumerate(splits):
            lo = 0 if sp.end is None else max(0, n - sp.end)
            train, test = range(lo, n - sp.train), range(n - sp.test - sp.horizon, n - sp.test)
            assert got[s, 1, j] == pytest.approx(np.mean([abs(y[k] - np.mean([y[i] for i in train])) for k in test]))
            by_dow = {d: np.mean([y[i] for i in train if i % 7 == d]) for d in range(7)}
            assert got[s, 0, j] == pytest.approx(np.mean([abs(y[k] - by_dow[k % 7]) for k in test]))
            prev = [y[i - 1] if i else min(y[k - 1] for k in train if k) for i in train]
            b, a = np.polyfit(prev, [y[i] for i in train], 1)
            last, path = y[train[-1]], {}
            for k in range(train[-1] + 1, test[-1] + 1):
                last = min(12.0, a + b * last)
                path[k] = last
            assert got[s, 2, j] == pytest.approx(np.mean([abs(y[k] - path[k]) for k in test]), rel=1e-6)
    # a series too short for a split has no score there
    assert ("c", 1, 0) in got and ("c", 1, 1) not in got
    best = {q.series: q.config for q in rolling_search.best_configs(scores, "MAE", ["series"]).collect()}
    assert best["a"] == 0


def test_detected_times_reach_design_and_components(spark):
    from tidewater.operators import changepoints, series_models

    turn, other = T0 + dt.timedelta(days=300), T0 + dt.timedelta(days=350)
    rows = []
    for s, size in (("a", 1.0), ("b", 2.0)):
        for k in range(700):
            t = T0 + dt.timedelta(days=k)
            trend = 0.05 * k + (0.2 * size * (k - 300) if k > 300 else 0)
            weekly = math.sin(2 * math.pi * (k % 7) / 7) * (4 if t >= other else 1)
            rows.append((s, t, 20 + trend + weekly, weekly))
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double, w double")
    trend = changepoints.estimate_trend(df, [turn], 0, ["series"], "ols")
    for s, size in (("a", 1.0), ("b", 2.0)):
        x = [r.trend for r in trend.filter(F.col("series") == s).orderBy("ts").collect()]
        late, early = x[650] - x[550], x[250] - x[150]
        assert (late - early) / 100 == pytest.approx(0.2 * size, rel=0.02)
    season = changepoints.estimate_seasonality(df, {"weekly": 1}, {"weekly": [other]}, [turn], ["series"], "ols")
    both = season.join(df.select("series", "ts", "w"), ["series", "ts"])
    assert both.agg(F.max(F.abs(F.col("weekly") - F.col("w")))).first()[0] < 0.05
    spec = ModelSpec(changepoints=[turn], seasonality={"weekly": 2}, seasonality_changepoints={"weekly": [other]})
    models = series_models.fit_series(df, spec, ["series"])
    parts = series_models.fitted_components(models)
    added = F.col("Intercept") + F.col("autoreg") + F.col("events") + F.col("seasonality") + F.col("trend") + F.col("OTHER")
    assert parts.agg(F.max(F.abs(added - F.col("forecast")))).first()[0] < 1e-8 and "sin1_tow_weekly_cp0" in models.names
    ahead = series_models.predict_series(models, series_models.future_of(models, 7))
    assert ahead.filter("forecast is not null").count() == 14
