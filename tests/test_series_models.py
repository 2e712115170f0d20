"""Keyed models against single runs and plain numpy; rows around training; stages."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import linear_model, multistage, series_models
from tidewater.operators.linear_model import ModelSpec

T0 = dt.datetime(2021, 3, 1)


def daily(spark, n=140, series=("a", "b", None), seed=0, missing=0):
    r = np.random.default_rng(seed)
    rows = []
    for k, s in enumerate(series):
        for i in range(n + 7 * k):
            y = None if missing and 5 < i < n - 5 and r.random() < missing else 50.0 + k + 0.1 * i + 5 * (i % 7 == k) + float(r.normal())
            rows.append((s, T0 + dt.timedelta(days=i), y, float(r.integers(0, 5))))
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double, reg double").repartition(6)


def frame(df, *cols):
    return df.select(*cols).toPandas().sort_values(list(cols[:2])).reset_index(drop=True)


SPECS = {
    "trend": ModelSpec(changepoints=[dt.datetime(2021, 5, 1)], seasonality={"weekly": 2}, uncertainty={"by": ["dow"], "quantiles": (0.1, 0.9)}),
    "lags beyond the horizon": ModelSpec(seasonality={}, autoreg={"orders": [7, 8], "intervals": [(7, 13)]}, algorithm="lasso", params={"alpha": 0.01}),
    "terms and limits": ModelSpec(growth="", seasonality={}, extra_terms=["C(dow)", "is_weekend:ct1"], upper=60.0, algorithm="elastic_net", params={"alpha": 0.001}),
}


@pytest.mark.parametrize("name", SPECS)
def test_keyed_models_equal_single_runs(spark, name):
    df, spec = daily(spark, missing=0.05), SPECS[name]
    models = series_models.fit_series(df, spec, ["series"])
    got = series_models.predict_series(models, series_models.future_of(models, 7)).toPandas()
    for s in ("a", "b"):
        one = linear_model.fit_linear(df.filter(F.col("series") == s).drop("series"), spec)
        expected = linear_model.predict_linear(one, linear_model.future_rows(spark, one, 7)).toPandas().sort_values("ts")
        own = got[got.series == s].sort_values("ts")
        assert own.part.eq("after").all() and len(own) == 7
        for c in ("forecast", "forecast_lower", "err_std") if spec.uncertainty else ("forecast",):
            assert np.allclose(own[c].to_numpy(), expected[c].to_numpy(), rtol=1e-9)
    assert models.coefficients().count() == 2 * len(models.names)
    # rows with a null key are no series
    assert got[got.series.isna()].empty or got[got.series.isna()].forecast.isna().all()


def test_one_series_without_keys(spark):
    df = daily(spark, series=("a",)).drop("series")
    models = series_models.fit_series(df, SPECS["trend"])
    got = series_models.predict_series(models, series_models.future_of(models, 3)).toPandas().sort_values("ts")
    one = linear_model.fit_linear(df, SPECS["trend"])
    assert np.allclose(got.forecast, linear_model.predict_linear(one, linear_model.future_rows(spark, one, 3)).toPandas().sort_values("ts").forecast, rtol=1e-9)


def test_rows_around_training_with_recursion(spark):
    df = daily(spark, 60, ("a", "b"))
    spec = ModelSpec(growth="", seasonality={}, autoreg={"orders": [1, 3], "intervals": [(1, 2)]}, regressors=["reg"], algorithm="ridge", params={"alpha": 0.5})
    models = series_models.fit_series(df, spec, ["series"])
    day = lambda k: T0 + dt.timedelta(days=k)
    asked = [("a", day(-3), 2.0), ("a", day(-1), 1.0), ("a", day(10), None), ("a", day(10), None), ("a", day(10) + dt.timedelta(hours=5), None), ("a", day(63), 4.0), ("a", day(66), 0.0), ("z", day(10), 1.0), (None, day(10), 1.0), ("a", None, 1.0)]
    rows = spark.createDataFrame(asked, "series string, ts timestamp_ntz, reg double")
    got = series_models.predict_series(models, rows)
    assert got.count() == len(asked)
    found = {(r.ts, r.part): r.forecast for r in got.filter("series = 'a' and ts is not null").collect()}
    beta = {r.term: r.estimate for r in models.coefficients().filter("series = 'a'").collect()}
    terms = {n: t for n, t in zip(models.names, models.table.filter("series = 'a'").first().terms, strict=True)}
    own = frame(df.filter("series = 'a'"), "ts", "y", "reg").sort_values("ts")
    y, reg = own.y.tolist(), own.reg.tolist()

    def value(lags, x):
        given = {"Intercept": 1.0, "reg": x} | lags
        return sum(beta[n] * (1.0 if n == "Intercept" else (v - terms[n].low) / terms[n].width) for n, v in given.items())

    def lagged(past):
        return {"y_lag1": past[-1], "y_lag3": past[-3], "y_avglag_1_to_2": (past[-1] + past[-2]) / 2}

    assert found[day(10), "inside"] == pytest.approx(value(lagged(y[:10]), reg[10]))
    assert found[day(10) + dt.timedelta(hours=5), "inside"] == pytest.approx(value(lagged(y[:11]), reg[11]))
    for k, x in ((-3, 2.0), (-1, 1.0)):
        assert found[day(k), "before"] == pytest.approx(value(lagged([y[0]] * 3), x))
    past = list(y)
    for k in range(60, 67):
        # on the way regressors are those of the latest row before
        x = {63: 4.0, 64: 4.0, 65: 4.0, 66: 0.0}.get(k, reg[-1])
        past.append(value(lagged(past), x))
        if k in (63, 66):
            assert found[day(k), "after"] == pytest.approx(past[-1])
    assert got.filter("series is null or series = 'z' or ts is null").filter("forecast is not null").isEmpty()


def test_penalties_chosen_on_folds_and_weights(spark):
    df = daily(spark, 90, ("a", "b"), 3).withColumn("w", F.when(F.dayofweek("ts") == 1, 0.0).otherwise(1.0))
    for algorithm in ("ridge", "lasso"):
        models = series_models.fit_series(df, ModelSpec(seasonality={"weekly": 2}, algorithm=algorithm, params={}), ["series"])
        fitted = series_models.fitted_series(models)
        assert fitted.agg(F.corr("y", "forecast")).first()[0] > 0.5
        assert models.table.filter("alpha > 0").count() == 2
    spec = ModelSpec(growth="", seasonality={}, extra_terms=["C(dow)"], algorithm="ols", params={})
    weighted = series_models.fitted_series(series_models.fit_series(df, spec, ["series"], weight="w")).filter(F.dayofweek("ts") != 1)
    plain = df.filter("w > 0").withColumn("m", F.expr("avg(y) over (partition by series, dayofweek(ts))"))
    both = weighted.join(plain.select("series", "ts", "m"), ["series", "ts"])
    assert both.agg(F.max(F.abs(F.col("m") - F.col("forecast")))).first()[0] < 1e-8


def test_events_reach_the_design_once(spark):
    df = daily(spark, 60, ("a",))
    events = spark.createDataFrame([("one", dt.date(2021, 3, 10), "event"), ("two", dt.date(2021, 3, 10), "event"), ("two", dt.date(2021, 3, 20), "event")], "event_key string, date date, event_name string")
    up = df.withColumn("y", F.col("y") + F.when(F.to_date("ts") == dt.date(2021, 3, 20), 100).otherwise(0))
    models = series_models.fit_series(up, ModelSpec(seasonality={}, event_keys=["one", "two"], algorithm="ols", params={}), ["series"], events)
    beta = {r.term: r.estimate for r in models.coefficients().collect()}
    assert beta["events_two"] > 80 and models.staged[0].count() == 60
    models.free()


def test_empty_and_unknown_series(spark):
    df = daily(spark, 30, ("a",))
    with pytest.raises(ValueError):
        series_models.fit_gram(None, ModelSpec(algorithm="rf"))
    none = series_models.fit_series(df.limit(0), ModelSpec(seasonality={}), ["series"])
    assert none.table.count() == 0 and series_models.predict_series(none, df.select("series", "ts").limit(2)).filter("forecast is null").count() == 2
    blank = df.unionByName(df.withColumns({"series": F.lit("b"), "y": F.lit(None).cast("double")}))
    some = series_models.fit_series(blank, ModelSpec(seasonality={}), ["series"])
    assert [r.series for r in some.table.collect()] == ["a"]


def hourly(spark, days=40, series=("a", "b")):
    r = np.random.default_rng(4)
    rows = [(s, T0 + dt.timedelta(hours=h + 5), 10.0 + k + h / 200 + 3 * ((h + 5) // 24 % 7 == 2) + 2 * float(np.sin((h + 5) % 24)) + float(r.normal())) for k, s in enumerate(series) for h in range(24 * days)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double").repartition(5)


def test_stages_against_numpy(spark):
    df = hourly(spark)
    weekday = ModelSpec(growth="", seasonality={}, extra_terms=["C(dow)"], algorithm="ols", params={})
    hour = ModelSpec(growth="", seasonality={}, extra_terms=["C(hour)"], algorithm="ols", params={})
    model = multistage.fit_multistage(df, [multistage.Stage(hour, None, "10 days"), multistage.Stage(weekday, "D", None, agg="mean")], "1 hour", ["series"], uncertainty={"by": ["hour"], "quantiles": (0.1, 0.9)})
    assert [s.freq for s in model.stages] == ["D", None]
    future = df.groupBy("series").agg(F.max("ts").alias("t")).select("series", F.explode(F.sequence(F.col("t") + F.expr("interval 1 hour"), F.col("t") + F.expr("interval 30 hours"), F.expr("interval 1 hour"))).alias("ts"))
    got = multistage.predict_multistage(model, future).toPandas()
    pdf = df.toPandas()
    for s, own in pdf.groupby("series"):
        own = own.sort_values("ts").assign(day=lambda x: x.ts.dt.floor("D"))
        days = own.groupby("day").agg(y=("y", "mean"), n=("y", "size"))
        days = days[days.n == 24]  # the first and last day are cut
        by_dow = days.groupby(days.index.dayofweek).y.mean()
        own["res"] = own.y - own.day.dt.dayofweek.map(by_dow)
        last = own[own.ts > own.ts.max() - pd.Timedelta(days=10)]
        by_hour = last.groupby(last.ts.dt.hour).res.mean()
        mine = got[got.series == s].sort_values("ts")
        assert np.allclose(mine.forecast_0, mine.ts.dt.dayofweek.map(by_dow)) and np.allclose(mine.forecast_1, mine.ts.dt.hour.map(by_hour))
        assert np.allclose(mine.forecast, mine.forecast_0 + mine.forecast_1)
        spread = (last.res - last.ts.dt.hour.map(by_hour)).groupby(last.ts.dt.hour).std()
        assert np.allclose(mine.err_std, mine.ts.dt.hour.map(spread)) and (mine.forecast_lower < mine.forecast).all()
    assert model.fitted.count() == 2 * 24 * 10
    model.free()


def test_fit_length_one_stage_and_errors(spark):
    df = hourly(spark, 20)
    spec = ModelSpec(growth="", seasonality={}, extra_terms=["C(hour)"], algorithm="ols", params={})
    short = multistage.fit_multistage(df, [multistage.Stage(spec, None, "3 days", "12 days")], "1 hour", ["series"])
    assert short.fitted.count() == 2 * 24 * 12
    with pytest.raises(ValueError):
        multistage.fit_multistage(df, [], "1 hour")
    alone = multistage.fit_multistage(df.filter("series = 'a'").drop("series"), [multistage.Stage(spec, None)], "1 hour")
    ahead = df.filter("series = 'a'").select((F.max("ts") + F.expr("interval 1 hour")).alias("ts"))
    assert multistage.predict_multistage(alone, ahead).first().forecast is not None


def test_saved_models_forecast_alike(spark, tmp_path):
    from tidewater.sources import models as saved

    spec = ModelSpec(changepoints=[dt.datetime(2021, 5, 1)], seasonality={"weekly": 2}, autoreg={"orders": [1, 7]}, extra_terms=["C(dow)"], uncertainty={"by": ["dow"], "quantiles": (0.1, 0.9)}, event_keys=["one"])
    events = spark.createDataFrame([("one", dt.date(2021, 3, 10), "event")], "event_key string, date date, event_name string")
    models = series_models.fit_series(daily(spark, 90, ("a", "b")), spec, ["series"], events)
    path = f"file://{tmp_path}/models"
    saved.save_series_models(models, path)
    again = saved.load_series_models(spark.newSession(), path)
    rows = series_models.future_of(models, 9)
    first = series_models.predict_series(models, rows).toPandas().sort_values(["series", "ts"]).reset_index(drop=True)
    models.free()
    second = series_models.predict_series(again, series_models.future_of(again, 9)).toPandas().sort_values(["series", "ts"]).reset_index(drop=True)
    assert np.allclose(first[["forecast", "forecast_lower", "err_std"]], second[["forecast", "forecast_lower", "err_std"]], rtol=1e-12) and len(second) == 18
    with pytest.raises(Exception):  # noqa: B017 - a folder that exists isn't overwritten
        saved.save_series_models(again, path)
