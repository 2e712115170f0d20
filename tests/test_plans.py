"""The forecaster's configuration: every component has its effect, and all regular frequencies run."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewater.plans import api
from tidewater.plans.api import Forecaster, best_of, interval_of, with_components
from tidewater.plans.config import Evaluation, ForecastConfig, Metadata, ModelComponents
from tidewater.plans.templates import parse_name

T0 = dt.datetime(2020, 1, 1)
PLAIN = "DAILY_SEAS_LT_GR_LINEAR_CP_NONE_HOL_NONE_FEASET_OFF_ALGO_RIDGE_AR_OFF"


def series(spark, times):
    return spark.createDataFrame([(t, 100.0 + 0.1 * k + 10 * math.sin(k)) for k, t in enumerate(times)], "ts timestamp_ntz, y double")


@pytest.mark.parametrize("freq,interval", [("5min", "5 minute"), ("2H", "2 hour"), ("W-SUN", "7 day"), ("QE", "3 month"), ("ME", "1 month"), ("2W", "14 day"), ("3D", "3 day")])
def test_intervals_of_frequencies(freq, interval):
    assert interval_of(freq) == interval


def test_no_frequency():
    for freq in (None, "fortnight", ""):
        with pytest.raises(ValueError, match="regular frequency"):
            interval_of(freq)


@pytest.mark.parametrize("times,after", [([T0 + k * dt.timedelta(minutes=5) for k in range(120)], dt.timedelta(minutes=5)), ([dt.datetime(2015 + k // 12, k % 12 + 1, 1) - dt.timedelta(1) for k in range(48)], None)])
def test_other_frequencies_run(spark, times, after):
    r = Forecaster().run(series(spark, times), ForecastConfig(template=PLAIN, horizon=3, evaluation=Evaluation(test_horizon=3)))
    got = sorted(x.ts for x in r.forecast.select("ts").collect())
    want = [times[-1] + k * after for k in (1, 2, 3)] if after else [dt.datetime(2018, 12, 31), dt.datetime(2019, 1, 31), dt.datetime(2019, 2, 28)]
    assert got == want and r.backtest.count() == 3


def test_components_reach_the_design(spark):
    components = ModelComponents(
        growth={"growth_term": "quadratic"},
        changepoints={"method": "custom", "dates": [T0 + dt.timedelta(40)]},
        seasonality={"weekly": 2, "daily": False},
        events={"daily": {"Sale": ["2020-02-01"]}, "holidays": False},
        autoregression={"autoreg": {"orders": [7]}},
        regressors={"columns": ["x"]},
        lagged_regressors={"z": {"orders": [3]}},
        uncertainty={"quantiles": (0.25, 0.75)},
        custom={"lower": 0.0, "extra_terms": ["is_weekend:ct1"]},
    )
    df = series(spark, [T0 + dt.timedelta(k) for k in range(107)]).withColumn("x", F.col("y") * 2).withColumn("z", F.col("y") + 1)
    df = df.withColumn("y", F.when(F.col("ts") < F.lit(T0 + dt.timedelta(100)), F.col("y")))
    # values end before the regressors, which the forecast needs
    r = Forecaster().run(df, ForecastConfig(template=PLAIN, horizon=7, components=components, metadata=Metadata(train_end=T0 + dt.timedelta(99))))
    names = set(r.model.design.columns)
    assert {"ct2", "changepoint0", "events_Sale", "y_lag7", "x", "z_lag3"} <= names and "ct1" not in names
    assert any("is_weekend" in n for n in names) and sum("weekly" in n for n in names) == 4
    assert r.model.spec.lower == 0.0 and tuple(r.model.ci.quantiles) == (0.25, 0.75)
    assert r.forecast.filter("forecast IS NOT NULL").count() == 7


def test_unknown_components_are_errors():
    for name in ("growth", "changepoints", "seasonality", "events", "autoregression", "regressors", "uncertainty", "custom"):
        with pytest.raises(ValueError, match="unknown keys"):
            with_components(parse_name(PLAIN), ModelComponents(**{name: {"nonsense": 1}}))


def test_the_best_configuration_by_metric():
    search = [{"config": k, "mean": m} for k, m in enumerate([0.2, None, 0.9, 0.9])]
    assert best_of(search, "MAPE")["config"] == 0 and best_of(search, "CORR")["config"] == 2
    with pytest.raises(ValueError, match="null for every"):
        best_of([{"config": 0, "mean": None}], "MAPE")


def test_period_ends():
    assert api.at_period_end("ME") and not api.at_period_end("MS")


def test_many_series_in_one_run(spark):
    one = series(spark, [T0 + dt.timedelta(k) for k in range(90)])
    both = one.withColumn("k", F.lit("a")).unionByName(series(spark, [T0 + dt.timedelta(k) for k in range(75)]).withColumns({"k": F.lit("b"), "y": F.col("y") * 3 + 5}))
    config = ForecastConfig(template=PLAIN, horizon=5, evaluation=Evaluation(test_horizon=5, cv_max_splits=2, cv_horizon=5, metric="MAE"), components=ModelComponents(custom={"grid": {"growth": ["ct1", ""]}}))
    keyed = ForecastConfig(**{**config.__dict__, "metadata": Metadata(keys=["k"])})
    got, alone = Forecaster().run(both, keyed), Forecaster().run(one, config)
    assert got.forecast.groupBy("k").count().collect() and got.forecast.count() == 10 and got.backtest.count() == 10
    mine = {r.ts: r.forecast for r in got.forecast.filter("k = 'a'").collect()}
    if got.settings["growth"] == alone.settings["growth"]:
        assert all(abs(mine[r.ts] - r.forecast) < 1e-6 for r in alone.forecast.collect())
    assert {r.k for r in got.scores.collect()} == {"a", "b"} and len(got.search) == 2 and all(len(r["scores"]) == 2 for r in got.search)
    with pytest.raises(ValueError, match="with keys"):
        Forecaster().run(both, ForecastConfig(template=PLAIN, horizon=5, metadata=Metadata(keys=["k"]), components=ModelComponents(custom={"algorithm": "rf"})))


def test_search_scores_equal_single_fits(spark):
    df = series(spark, [T0 + dt.timedelta(k) for k in range(80)])
    config = ForecastConfig(template=PLAIN, horizon=4, evaluation=Evaluation(cv_max_splits=3, metric="RMSE"), components=ModelComponents(custom={"grid": {"growth": ["ct1", ""], "autoreg": [None, {"orders": [1, 2]}]}}))
    found = Forecaster().run(df, config).search
    assert len(found) == 4
    from tidewater.operators.evaluation import rolling_splits

    splits = rolling_splits(80, 4, None, 4, 0, True, 3)
    for r in found:
        for score, (train, test) in zip(r["scores"], splits, strict=True):
            assert score == pytest.approx(Forecaster()._score(df, r["settings"], "1 day", 86400, 80, train, test, "RMSE"), rel=1e-6)
