"""Grids, calendar features, lags and cleaning on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater import schema
from tidewater.functions import calendar as cal
from tidewater.operators import clean, lags, timegrid

DAY = dt.timedelta(1)
T0 = dt.datetime(2018, 1, 1)


def series(spark, values, start=T0, step=DAY):
    return spark.createDataFrame([(start + k * step, None if v is None else float(v)) for k, v in enumerate(values)], "ts timestamp_ntz, y double")


def column(df, name, by="ts"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_lags(spark):
    df = series(spark, range(10)).withColumns(lags.lag_columns("y", [1, 2, 5]))
    assert column(df, "y_lag1")[2] == 1 and column(df, "y_lag2")[7] == 5 and column(df, "y_lag5")[8] == 3
    assert column(df, "y_lag5")[4] is None


def test_aggregated_lags(spark):
    df = series(spark, [1, 5, 6, 7, 8, -1, -10, -19, -20, 10])
    out = df.withColumns(lags.aggregated_lag_columns("y", [[1, 2, 5], [1, 3, 8]], [(1, 5), (1, 8)]))
    assert column(out, "y_avglag_1_2_5")[2] == 3.0
    assert round(column(out, "y_avglag_1_to_8")[7], 1) == -0.6 or round(column(out, "y_avglag_1_to_8")[7], 1) == 2.3
    assert column(out, "y_avglag_1_2_5")[0] is None
    with pytest.raises(ValueError):
        lags.aggregated_lag_columns("y", [[1, 1]])
    with pytest.raises(ValueError):
        lags.aggregated_lag_columns("y", intervals=[(1, 2, 3)])


def test_gaps(spark):
    rows = [(dt.datetime(2018, 1, 1, 0, 0, s), float(v)) for s, v in ((1, 1), (2, 2), (10, 3), (4, 4))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, y double")
    gaps = [(r.before.second, r.after.second, r.gap_size) for r in timegrid.find_gaps(df).orderBy("before").collect()]
    assert gaps == [(2, 4, 1.0), (4, 10, 5.0)]
    assert column(timegrid.fill_gaps(df, "1 second"), "y") == [1, 2, None, 4, None, None, None, None, None, 3]
    assert tuple(timegrid.fill_gap_counts(df, "1 second").first()) == (6, 0)


def test_canonicalise(spark):
    rows = [(T0, 1.0), (T0 + 2 * DAY, float("inf")), (T0 + 3 * DAY, 4.0), (T0 + 4 * DAY, None)]
    c = timegrid.canonicalise(spark.createDataFrame(rows, "ts timestamp_ntz, y double"), "1 day")
    assert column(c.df, "y") == [1.0, None, None, 4.0, None] and c.train_end == T0 + 3 * DAY and c.added == 1
    with pytest.raises(ValueError):
        timegrid.canonicalise(series(spark, [1, 2]), "1 day")


@pytest.mark.parametrize(("step", "want"), [(dt.timedelta(hours=1), "H"), (DAY, "D"), (dt.timedelta(3), "3D")])
def test_infer_frequency(spark, step, want):
    assert timegrid.infer_frequency(series(spark, range(6), step=step)) == want


def test_infer_months_and_none(spark):
    months = spark.createDataFrame([(dt.datetime(2020, m, 1), 1.0) for m in range(1, 8)], "ts timestamp_ntz, y double")
    assert timegrid.infer_frequency(months) == "MS"
    odd = spark.createDataFrame([(T0, 1.0), (T0 + DAY, 1.0), (T0 + 4 * DAY, 1.0)], "ts timestamp_ntz, y double")
    assert timegrid.infer_frequency(odd) is None


def test_aggregate_from_end(spark):
    assert column(timegrid.aggregate_from_end(series(spark, range(15)), 7), "y") == [28, 77]
    assert column(timegrid.aggregate_from_end(series(spark, [1, 2]), 3), "y") == [3]
    assert column(timegrid.aggregate_from_end(series(spark, range(1, 8)), 3, "maximum"), "y") == [4, 7]


def test_time_features(spark):
    df = series(spark, range(8760), dt.datetime(2019, 1, 1), dt.timedelta(hours=1))
    rows = cal.add_time_features(df, origin=2019.0).orderBy("ts").collect()
    r = rows[0]
    assert (r.year_length, r.quarter, r.dow, r.str_dow, r.woy, r.year_woy, r.dow_hr, r.tow, r.dow_grouped) == (365.0, 1, 2, "2-Tue", 1, "2019_01", "2_00", 1.0, "1234-MTuWTh")
    assert rows[24 * 80].year_quarter == "2019-1" and rows[24 * 16].toq == 16 / 90 and rows[24 * 91].toq == 1 / 91
    last = rows[-1]
    assert (last.year_iso, last.year_woy_dow_iso) == (2020, "2020_01_2")
    assert rows[0].ct1 == 0.0


def test_leap_day_is_frozen(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 2, 28),), (dt.datetime(2020, 2, 29, 12),), (dt.datetime(2020, 3, 1),), (dt.datetime(2020, 12, 31),)], "ts timestamp_ntz")
    toy = column(df.withColumn("toy", cal.time_features()["toy"]), "toy")
    assert toy == [58 / 365, 59 / 365, 59 / 365, 364 / 365]


def test_dst(spark):
    when = [dt.datetime(2019, 3, 10, 1, 59), dt.datetime(2019, 3, 10, 2), dt.datetime(2019, 11, 3, 2), dt.datetime(2019, 11, 3, 2, 1), dt.datetime(2006, 7, 1)]
    df = spark.createDataFrame([(t,) for t in when], "ts timestamp_ntz").withColumn("d", cal.is_dst(F.col("ts")))
    by = {r.ts: r.d for r in df.collect()}
    assert [by[t] for t in when] == [False, True, True, False, False]
    with pytest.raises(ValueError):
        cal.is_dst(F.col("ts"), "moon")


def test_fourier_names():
    assert list(cal.fourier_terms("tod", 24, 1, "daily")) == ["sin1_tod_daily", "cos1_tod_daily"]


def test_interpolate_and_impute(spark):
    df = series(spark, [None, 1, None, None, 4, None])
    assert column(clean.interpolate(df), "y") == [1, 1, 2, 3, 4, 4]
    df = series(spark, [*range(70), None, None, None])
    assert column(clean.impute_with_lags(df, orders=[7]), "y")[-3:] == [63, 64, 65]
    assert column(clean.impute_with_lags(df, orders=[7, 14, 21], iterations=1), "y")[-3:] == [56, 57, 58]


def test_outliers(spark):
    values = [float(k % 7) for k in range(100)]
    values[2] = 1000.0
    z = clean.zscore_outliers(series(spark, values))
    assert [k for k, x in enumerate(column(z, "is_outlier")) if x] == [2]
    t = clean.tukey_outliers(series(spark, values))
    assert [k for k, x in enumerate(column(t, "is_outlier")) if x] == [2]
    flat = clean.zscore_outliers(series(spark, [1.0] * 20))
    assert not any(column(flat, "is_outlier"))
    masked = clean.mask_outliers(series(spark, values), 5)
    assert column(masked, "y")[2] is None


def test_normalise(spark):
    df = series(spark, [0, 5, 10])
    assert column(clean.normalise(df, ["y"]), "y") == [0, 0.5, 1]
    assert column(clean.normalise(df, ["y"], "minus_half_to_half"), "y") == [-0.5, 0, 0.5]
    assert column(clean.normalise(df, ["y"], "zero_at_origin"), "y") == [0, 0.5, 1]
    assert column(clean.normalise(series(spark, [3, 3]), ["y"]), "y") == [0, 0]


def test_adjust_intervals(spark):
    df = series(spark, range(10))
    rows = [(T0, T0 + DAY, None), (T0 + 3 * DAY, T0 + 5 * DAY, 3.0), (dt.datetime(2099, 1, 1), dt.datetime(2099, 1, 2), None)]
    a = spark.createDataFrame(rows, "start_time timestamp_ntz, end_time timestamp_ntz, adjustment_delta double")
    assert column(clean.adjust_intervals(df, a, ["y"]), "y") == [None, None, 2, 6, 7, 8, 6, 7, 8, 9]
    twice = spark.createDataFrame([(T0, T0 + DAY, 1.0), (T0 + DAY, T0 + 2 * DAY, 2.0)], a.schema)
    assert column(clean.adjust_intervals(df, twice, ["y"]), "y")[:4] == [1, 4, 4, 3]


def test_degenerate_and_columns(spark):
    df = series(spark, [1, 2]).withColumns({"a": F.lit(1), "b": F.lit(None).cast("int")})
    assert clean.degenerate_columns(df, ["y", "a", "b"]) == ["a"]
    assert schema.columns_like(["sin1_tow", "ct1", "x"], schema.SEASONALITY_REGEX) == ["sin1_tow"]
    assert schema.split_by_patterns(["ab", "ac", "b"], {"x": "a", "y": "ac"}) == ({"x": ["ab", "ac"], "y": []}, ["b"])
    with pytest.raises(ValueError):
        schema.ingest(df, "nope", "y")


def test_exponential_mean(spark):
    out = column(clean.exponential_mean(series(spark, [1, 2, 3]), 0.5), "ewm")
    assert out == pytest.approx([1, (2 + 0.5) / 1.5, (3 + 1 + 0.25) / 1.75])


def test_simple_frequency():
    assert [schema.simple_frequency(s).name for s in (60, 3600, 86400, 7 * 86400, 30 * 86400, 365 * 86400, 800 * 86400)] == ["MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "YEAR", "MULTIYEAR"]
