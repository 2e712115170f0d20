"""Automatic settings, penalised quantiles, splits, streaming and tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater import schema
from tidewater.functions import calendar as cal
from tidewater.operators import auto, clean, intervals, regression, timegrid
from tidewater.sources import tables
from tidewater.streaming import scoring

T0 = dt.datetime(2020, 1, 1)


def daily(spark, n=800):
    rng = np.random.default_rng(2)
    rows = [(T0 + dt.timedelta(k), float(50 + 0.2 * k + 8 * math.sin(2 * math.pi * k / 7) + rng.normal(0, 1) + (40 if (T0 + dt.timedelta(k)).timetuple()[1:3] == (12, 25) else 0))) for k in range(n)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, y double")


def test_auto_settings(spark):
    df = daily(spark)
    assert auto.auto_seasonality(df, ["weekly", "daily"])["weekly"] == 1
    assert auto.auto_growth(df)["growth"] == "ct1"
    groups = {r.event_key: r for r in auto.auto_holidays(df, ["US"]).collect()}
    top = max(groups.values(), key=lambda r: r.avg_score)
    assert top.event_key.startswith("Christmas_Day") and top.group == max(r.group for r in groups.values())


def test_penalised_and_split_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = 2 + 3 * x[:, 0] + rng.normal(0, 0.5, 300)
    df = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, c double, y double")
    cols = {"Intercept": F.lit(1.0), **{n: F.col(n) for n in "abc"}}
    folds = regression.contiguous_folds(df, cols, F.col("y"), 4, F.col("k"))
    assert len(folds) == 4 and regression.total_of(folds).rows == 300
    fit = regression.fit_partial_cv(folds, ["b", "c"], [0.01, 0.3], ["a"], [0.0, 10.0]).coefficients()
    assert fit["a"] == pytest.approx(3, abs=0.2) and abs(fit["b"]) < 0.1
    q = regression.fit_l1_quantile(df, cols, F.col("y"), 0.5, 0.05, rounds=8).coefficients()
    assert q["a"] == pytest.approx(3, abs=0.3) and abs(q["c"]) < 0.1
    p = regression.split_inference(df, cols, F.col("y"), 0.2, 10)
    assert p["a"] < 1e-6 and p["b"] > 0.05
    model = intervals.quantile_model(df.withColumn("r", F.col("y") - 3 * F.col("a") - 2), {"Intercept": F.lit(1.0)}, "r", [0.1, 0.9])
    r = intervals.apply_quantile_model(df.withColumn("forecast", F.lit(0.0)), {"Intercept": F.lit(1.0)}, model).first()
    assert -1 < r.quantile_summary[0] < 0 < r.quantile_summary[1] < 1


def test_streaming_windows_and_scores(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=7 * k), "a", float(k)) for k in range(20)]
    spark.createDataFrame(rows, "ts timestamp, series string, actual double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, series string, actual double").parquet(str(tmp_path / "in"))
    q = scoring.windowed(stream, {"n": F.count("*"), "s": F.sum("actual")}, "1 hour", "10 minutes", ["series"]).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.ts.hour: (r.n, r.s) for r in spark.table("windows").collect()}
    assert got == {0: (9, 36.0), 1: (9, 117.0), 2: (2, 37.0)}
    past = spark.createDataFrame([(float(x),) for x in (-1, 1) * 10], "r double")
    model = intervals.fit_intervals(past, "r", [0.025, 0.975])
    known = spark.createDataFrame([(t, 10.0) for t, *_ in rows], "ts timestamp, forecast double")
    q = scoring.score(stream, known, model).select("ts", "actual", "is_anomaly_predicted").writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.actual for r in spark.table("scored").filter("not is_anomaly_predicted").collect()) == [8.0, 9.0, 10.0, 11.0, 12.0]


def test_tables(spark, tmp_path):
    df = daily(spark, 40)
    df.write.parquet(str(tmp_path / "one.parquet"))
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "two.csv"))
    assert tables.list_tables(spark, str(tmp_path)) == ["one", "two"]
    assert tables.read_table(spark, str(tmp_path), "one").count() == tables.read_table(spark, str(tmp_path), "two").count() == 40
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path), "three")
    weekly = tables.aggregated(df, "weekly", {"y": "sum"})
    assert weekly.count() == timegrid.resample(df, "W-MON", {"y": F.sum("y")}).count()
    fit = regression.Fit(["a"], np.array([1.0]), 0.5)
    tables.save_model(spark, fit, str(tmp_path / "m"))
    assert tables.load_model(spark, str(tmp_path / "m"), [regression.Fit]).alpha == 0.5


def test_single_series_queries_use_orders_of_every_status(spark, tmp_path):
    from tidewater.queries import QUERIES

    rows = [("OPF"[k % 3], k // 3, 100.0 + k % 21) for k in range(1200)]
    day = F.expr("date_add(date'1996-01-01', k)").cast("timestamp_ntz")
    orders = spark.createDataFrame(rows, "o_orderstatus string, k int, o_totalprice double").withColumn("o_orderdate", day).drop("k")
    orders.write.parquet(str(tmp_path / "all" / "orders.parquet"))
    orders.filter("o_orderstatus = 'F'").write.parquet(str(tmp_path / "f" / "orders.parquet"))
    every, only = (QUERIES["seasonality_orders"](spark, str(tmp_path / x)).collect() for x in ("all", "f"))
    assert len(every) == len(only) == 8 and every[0].aic != only[0].aic
    forecast = QUERIES["forecast_linear_simulated"](spark, str(tmp_path / "all")).agg(F.avg("forecast")).first()[0]
    assert forecast == pytest.approx(330, rel=0.05)


def test_folds_are_runs_without_a_sort(spark):
    df = spark.range(0, 103, numPartitions=7).select((F.lit(102) - F.col("id")).alias("k"))
    placed = regression.with_folds(df, 5, F.col("k"))
    sizes = placed.groupBy("_fold").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).orderBy("_fold").collect()
    assert [r.n for r in sizes] == [21, 21, 20, 21, 20] and all(x.b < y.a for x, y in zip(sizes, sizes[1:]))
    assert "Window" not in placed._jdf.queryExecution().executedPlan().toString()
    assert regression.with_folds(df, 4).select("_fold").distinct().count() == 4
    assert regression.with_folds(df, 4, F.lit(1)).select("_fold").distinct().count() == 4
    nulls = regression.with_folds(spark.createDataFrame([(None,), (1,), (2,), (3,)], "k int"), 2, F.col("k"))
    assert {r.k: r["_fold"] for r in nulls.collect()}[None] == 1


def test_rank_scaled_is_percent_rank(spark):
    rng = np.random.default_rng(4)
    rows = [(k, None if k % 17 == 0 else float(rng.integers(0, 40))) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = {r.k: r.x for r in clean.scale_features(df, ["x"], "QuantileTransformer").collect()}
    order = sorted(-math.inf if x is None else x for _, x in rows)
    first = {v: order.index(v) for v in set(order)}
    assert all(math.isclose(got[k], first[-math.inf if x is None else x] / 499) for k, x in rows)
    assert clean.scale_features(df.limit(1), ["x"], "QuantileTransformer").first().x == 0.0
    assert clean.scale_features(df.limit(0), ["x"], "QuantileTransformer").count() == 0


def test_rank_scaled_counts_each_column_in_the_table_itself(spark, tmp_path, monkeypatch):
    odd = "CASE WHEN id % 3 = 0 THEN 7.5D WHEN id % 11 = 0 THEN NULL WHEN id % 101 = 0 THEN double('NaN') WHEN id % 103 = 0 THEN -0.0D ELSE sin(id) * id END AS x"
    made = spark.range(0, 5000, numPartitions=3).select("id", F.expr(odd), F.expr("double(id % 5) AS y"), F.expr("int(id * 7919 % 4001) AS z"))
    made.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    ranks = [F.percent_rank().over(Window.orderBy(c)).alias(c) for c in "xyz"]
    want = {r.id: r[1:] for r in df.select("id", *ranks).collect()}
    for few in (50_000, 0):
        monkeypatch.setattr(clean, "BROADCAST_VALUES", few)
        got = clean.scale_features(df, ["x", "y", "z"], "QuantileTransformer")
        assert {r.id: r[1:] for r in got.collect()} == want
        lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert sum("Relation [" in x for x in lines) == 7 and sum("Join " in x for x in lines) == 6  # per column: counts, sums by range
        assert not any("Filter" in x and "CASE" in x for x in lines)  # ranges are found for distinct values, not for rows
    assert clean.rank_scaled(df, "y", "y").agg(F.max("y")).first()[0] == max(w[1] for w in want.values())


def test_zone_daylight_saving(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15, 12),), (dt.datetime(2024, 7, 15, 12),)], "ts timestamp_ntz")
    seen = {z: [r[0] for r in df.orderBy("ts").select(cal.zone_dst(F.col("ts"), z)).collect()] for z in ("America/New_York", "Australia/Sydney", "Asia/Tokyo")}
    assert seen == {"America/New_York": [False, True], "Australia/Sydney": [True, False], "Asia/Tokyo": [False, False]}


def test_significant_digits_and_columns(spark):
    df = spark.createDataFrame([(0.0123456, 1, "a"), (-98765.4321, 2, "b"), (0.0, 3, "c"), (None, 4, "d")], "x double, k int, s string")
    assert [r[0] for r in df.orderBy("k").select(cal.round_significant(F.col("x"), 3)).collect()] == [0.0123, -98765.0, 0.0, None]
    assert schema.columns_of_type(df, ["double", "int"]) == ["x", "k"] and schema.columns_of_type(df, exclude=["int"]) == ["x", "s"]
    assert schema.reorder(df, {"s": 1, "k": 0}).columns == ["k", "s", "x"]


def test_future_parts(spark):
    day = lambda k: T0 + dt.timedelta(k)
    train = spark.createDataFrame([("a", day(k)) for k in range(5, 10)], "series string, ts timestamp_ntz")
    future = spark.createDataFrame([("a", day(3)), ("a", day(7)), ("a", day(12)), ("a", day(13)), ("b", day(1))], "series string, ts timestamp_ntz")
    got = sorted((r.series, (r.ts - T0).days, r.part) for r in timegrid.partition_future(train, future, "1 day", ["series"]).collect())
    assert got == [("a", 3, "before"), ("a", 7, "inside"), ("a", 10, "gap"), ("a", 11, "gap"), ("a", 12, "after"), ("a", 13, "after"), ("b", 1, None)]
    next_day = timegrid.partition_future(train.drop("series"), future.filter("series = 'a'").drop("series").filter(F.col("ts") < F.lit(day(12))), "1 day")
    assert next_day.filter("part = 'gap'").count() == 0 and next_day.count() == 2
    assert timegrid.partition_future(train, future.limit(0), "1 day", ["series"]).count() == 0


def test_prediction_scale_and_partial_ridge(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 45))
    names = [f"x{k}" for k in range(45)]
    df = spark.createDataFrame([(*map(float, r), float(r[0] + rng.normal())) for r in x], ", ".join(f"{n} double" for n in names) + ", y double")
    columns = {"Intercept": F.lit(1.0)} | {n: F.col(n) for n in names}
    g = regression.gram(df, columns, F.col("y"))
    fit = regression.fit_ols(g)
    full = np.column_stack([np.ones(60), x])
    want = np.sqrt(1 + np.einsum("ij,jk,ik->i", full, np.linalg.inv(full.T @ full), full))
    got = [r.s for r in df.select(regression.prediction_scale(columns, g, fit).alias("s")).collect()]
    assert np.allclose(sorted(got), sorted(want), rtol=1e-6)
    assert np.allclose(regression.fit_partial(g, l2=names, l2_alpha=7.0).beta[1:], np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 7 * np.eye(45), (x - x.mean(0)).T @ np.array([r.y for r in df.select("y").collect()])), atol=1e-5)
