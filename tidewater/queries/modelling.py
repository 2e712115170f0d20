"""Queries of events, forecasters, intervals, metrics and evaluation."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import calendar as cal
from tidewater.functions import metrics as m
from tidewater.operators import evaluation, events, forecasters, intervals, timegrid
from tidewater.queries._base import EG, EH, OD, OG, events_hourly, orders_daily, query, rounded, table
from tidewater.queries.features import daily_grid

K = ["series"]

# ---- forecasts: hourly series of events, the last day forecast from the mean of weekday and hour

SPLIT = EG + ", sp AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 24 AS is_test, isodow(ts) || '_' || strftime(ts, '%H') AS dow_hr FROM eg)"
SIM = SPLIT + (
    ", own AS (SELECT series, dow_hr, avg(y) AS a FROM sp WHERE NOT is_test AND y IS NOT NULL GROUP BY 1, 2), every AS (SELECT series, avg(y) AS b FROM sp WHERE NOT is_test AND y IS NOT NULL GROUP BY 1), "
    "sim AS (SELECT series, ts, y AS actual, coalesce(a, b) AS forecast, b AS forecast_null, is_test, dow_hr FROM sp LEFT JOIN own USING (series, dow_hr) JOIN every USING (series))"
)


def similarity(spark: SparkSession, d: str) -> DataFrame:
    """(series, ts, actual, forecast, forecast_null, is_test, dow_hr) over the whole grid."""
    g = timegrid.fill_gaps(events_hourly(spark, d), "1 hour", K)
    sp = cal.add_time_features(timegrid.train_test_split(g, 24, K), ["dow_hr"])
    train = sp.filter(~F.col("is_test"))
    out = forecasters.similarity_forecast(train, sp, ["dow_hr"], keys=K)
    return forecasters.null_forecast(train, out, keys=K).withColumnRenamed("y", "actual")


@query("forecast_similarity", f"WITH {SIM} SELECT series, ts, actual, round(forecast, 4) AS forecast, round(forecast_null, 4) AS forecast_null FROM sim WHERE is_test")
def _(spark, d):
    return rounded(similarity(spark, d).filter("is_test").select("series", "ts", "actual", "forecast", "forecast_null"), 4)


@query(
    "forecast_similarity_recent",
    f"WITH {SPLIT}, r AS (SELECT *, row_number() OVER (PARTITION BY series, dow_hr ORDER BY ts DESC) AS r FROM sp WHERE NOT is_test AND y IS NOT NULL), own AS (SELECT series, dow_hr, median(y) AS a FROM r WHERE r <= 3 GROUP BY 1, 2), every AS (SELECT series, median(y) AS b FROM sp WHERE NOT is_test GROUP BY 1) "
    "SELECT series, ts, round(coalesce(a, b), 4) AS forecast FROM sp LEFT JOIN own USING (series, dow_hr) JOIN every USING (series) WHERE is_test",
)
def _(spark, d):
    g = timegrid.fill_gaps(events_hourly(spark, d), "1 hour", K)
    sp = cal.add_time_features(timegrid.train_test_split(g, 24, K), ["dow_hr"])
    out = forecasters.similarity_forecast(sp.filter(~F.col("is_test")), sp.filter("is_test"), ["dow_hr"], "median", K, recent=3)
    return rounded(out.select("series", "ts", "forecast"), 4)


_DSPLIT = OG + ", sp AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 14 AS is_test FROM og), h AS (SELECT * FROM sp WHERE NOT is_test), f AS (SELECT series, ts FROM sp WHERE is_test)"


def _daily_split(spark, d):
    sp = timegrid.train_test_split(daily_grid(spark, d), 14, K)
    return sp.filter(~F.col("is_test")), sp.filter("is_test").select("series", "ts")


@query("forecast_week_over_week", f"WITH {_DSPLIT}, one AS (SELECT f.series, f.ts, h.y FROM f LEFT JOIN h ON h.series = f.series AND h.ts = f.ts - INTERVAL 7 DAY) SELECT a.series, a.ts, coalesce(h.y, b.y) AS forecast FROM one a LEFT JOIN h ON h.series = a.series AND h.ts = a.ts - INTERVAL 7 DAY LEFT JOIN one b ON b.series = a.series AND b.ts = a.ts - INTERVAL 7 DAY")
def _(spark, d):
    h, f = _daily_split(spark, d)
    return forecasters.lag_forecast(h, f, [1], "week", "mean", K, rounds=2).select("series", "ts", "forecast")


@query("forecast_wow_median3", f"WITH {_DSPLIT}, k AS (SELECT unnest([2, 3, 4]) AS k) SELECT f.series, f.ts, median(h.y) AS forecast FROM f CROSS JOIN k LEFT JOIN h ON h.series = f.series AND h.ts = f.ts - to_days((7 * k)::INTEGER) GROUP BY 1, 2")
def _(spark, d):
    h, f = _daily_split(spark, d)
    return forecasters.lag_forecast(h, f, [2, 3, 4], "week", "median", K).select("series", "ts", "forecast")


@query("forecast_null_quantile", f"WITH {_DSPLIT} SELECT f.series, f.ts, q.q AS forecast_null FROM f JOIN (SELECT series, round(quantile_cont(y, 0.8), 4) AS q FROM h GROUP BY 1) q USING (series)")
def _(spark, d):
    h, f = _daily_split(spark, d)
    return rounded(forecasters.null_forecast(h, f, "quantile", quantile=0.8, keys=K), 4)


@query("forecast_by_horizon_block", f"WITH {_DSPLIT}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM f) SELECT series, ts, CASE WHEN i <= 7 THEN 'near' ELSE 'far' END AS model FROM r")
def _(spark, d):
    return forecasters.horizon_blocks(_daily_split(spark, d)[1], [(7, "near"), (7, "far")], K)


# ---- intervals

_RES = SIM + ", res AS (SELECT *, actual - forecast AS r, isodow(ts) AS dow FROM sim WHERE NOT is_test AND actual IS NOT NULL)"


def _residuals(spark, d):
    s = cal.add_time_features(similarity(spark, d), ["dow"])
    return s, s.filter(~F.col("is_test") & F.col("actual").isNotNull()).withColumn("r", F.col("actual") - F.col("forecast"))


@query("residual_distribution", f"WITH {_RES} SELECT dow::INTEGER AS dow, count(*) AS n, round(avg(r), 4) AS mean, round(stddev_samp(r), 4) AS std, round(min(r), 4) AS min, round(max(r), 4) AS max, round(quantile_cont(r, 0.1) - avg(r), 4) AS q10, round(quantile_cont(r, 0.9) - avg(r), 4) AS q90 FROM res GROUP BY 1")
def _(spark, d):
    s = intervals.slice_distributions(_residuals(spark, d)[1], "r", [0.1, 0.9], ["dow"])
    return rounded(s.select("dow", "n", "mean", "std", "min", "max", F.col("qs")[0].alias("q10"), F.col("qs")[1].alias("q90")), 4)


_Z = NormalDist().inv_cdf(0.975)


def _ci(spark, d, method):
    s, r = _residuals(spark, d)
    model = intervals.fit_intervals(r, "r", [0.025, 0.975], ["dow"], method)
    out = intervals.with_bounds(intervals.apply_intervals(s.filter("is_test"), model, lower=0.0))
    return rounded(out.select("series", "ts", "forecast", "forecast_lower", "forecast_upper", "err_std"), 4)


@query(
    "ci_normal",
    f"WITH {_RES}, st AS (SELECT dow, count(*) AS n, stddev_samp(r) AS std FROM res GROUP BY 1) SELECT series, ts, round(forecast, 4) AS forecast, round(greatest(forecast - {_Z!r} * std, 0), 4) AS forecast_lower, round(greatest(forecast + {_Z!r} * std, 0), 4) AS forecast_upper, round(std, 4) AS err_std FROM sim JOIN st ON st.dow = isodow(ts) WHERE is_test",
)
def _(spark, d):
    return _ci(spark, d, "normal_fit")


@query(
    "ci_ecdf",
    f"WITH {_RES}, st AS (SELECT dow, stddev_samp(r) AS std, quantile_cont(r, 0.025) - avg(r) AS lo, quantile_cont(r, 0.975) - avg(r) AS hi FROM res GROUP BY 1) SELECT series, ts, round(forecast, 4) AS forecast, round(greatest(forecast + lo, 0), 4) AS forecast_lower, round(greatest(forecast + hi, 0), 4) AS forecast_upper, round(std, 4) AS err_std FROM sim JOIN st ON st.dow = isodow(ts) WHERE is_test",
)
def _(spark, d):
    return _ci(spark, d, "ecdf")


# ---- metrics, over the fitted part and the test part

_BAND = SIM + ", b AS (SELECT *, forecast * 0.5 AS lo, forecast * 1.5 AS hi FROM sim WHERE actual IS NOT NULL)"


def _band(spark, d):
    s = similarity(spark, d).filter("actual is not null")
    return s.withColumns({"forecast_lower": F.col("forecast") * 0.5, "forecast_upper": F.col("forecast") * 1.5})


_POINT = """round(CASE WHEN min(actual) < max(actual) AND min(forecast) < max(forecast) THEN corr(actual, forecast) END, 6) AS "CORR", round(1 - sum((actual - forecast) ** 2) / (var_pop(actual) * count(*)), 6) AS "R2", round(avg((actual - forecast) ** 2), 3) AS "MSE", round(sqrt(avg((actual - forecast) ** 2)), 3) AS "RMSE",
  round(avg(abs(actual - forecast)), 3) AS "MAE", round(median(abs(actual - forecast)), 3) AS "MedAE", round(CASE WHEN min(abs(actual)) > 0 THEN avg(100 * abs(actual - forecast) / abs(actual)) END, 3) AS "MAPE", round(CASE WHEN min(abs(actual)) > 0 THEN median(100 * abs(actual - forecast) / abs(actual)) END, 3) AS "MedAPE",
  round(CASE WHEN min(abs(actual) + abs(forecast)) > 0 THEN avg(100 * abs(actual - forecast) / (abs(actual) + abs(forecast))) END, 3) AS "sMAPE\""""
_PIN = ", ".join(f"""round(avg(CASE WHEN actual < forecast THEN {1 - q!r}::DOUBLE * (forecast - actual) ELSE {q!r}::DOUBLE * (actual - forecast) END), 3) AS "Q{n}\"""" for q, n in ((0.8, 80), (0.95, 95), (0.99, 99)))
_TOL = ", ".join(f"""round(avg(CASE WHEN abs(forecast - actual) > {k / 100!r}::DOUBLE * abs(actual) THEN 1.0 ELSE 0.0 END), 6) AS "OutsideTolerance{k}p\"""" for k in (1, 2, 3, 4, 5))


def _point(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6 if c in ("CORR", "R2") or c.startswith("Out") else 3).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("metrics_point", f"WITH {_BAND} SELECT series, is_test, {_POINT}, {_PIN}, {_TOL} FROM b GROUP BY 1, 2")
def _(spark, d):
    return _point(m.evaluate(_band(spark, d), ["series", "is_test"]))


@query("metrics_grouped_dow", f"WITH {_BAND} SELECT isodow(ts)::INTEGER AS dow, {_POINT} FROM b GROUP BY 1")
def _(spark, d):
    df = cal.add_time_features(_band(spark, d), ["dow"])
    return _point(m.evaluate(df, ["dow"], ["CORR", "R2", "MSE", "RMSE", "MAE", "MedAE", "MAPE", "MedAPE", "sMAPE"]))


@query(
    "metrics_interval",
    f"""WITH {_BAND} SELECT series, round(CASE WHEN min(abs(actual)) > 0 THEN avg(100 * abs(hi - lo) / abs(actual)) END, 4) AS "PREDICTION_BAND_WIDTH", round(avg((actual > lo AND actual < hi)::INTEGER), 6) AS "PREDICTION_BAND_COVERAGE",
    round(avg((actual > lo AND actual < forecast)::INTEGER), 6) AS "LOWER_BAND_COVERAGE", round(avg((actual > forecast AND actual < hi)::INTEGER), 6) AS "UPPER_BAND_COVERAGE", round(avg((actual > lo AND actual < hi)::INTEGER) - 0.9, 6) AS "COVERAGE_DIFF",
    round(avg(hi - lo + CASE WHEN actual < lo THEN 2 / {1 - 0.9!r}::DOUBLE * (lo - actual) WHEN actual > hi THEN 2 / {1 - 0.9!r}::DOUBLE * (actual - hi) ELSE 0 END), 4) AS "MIS" FROM b GROUP BY 1""",
)
def _(spark, d):
    df = m.evaluate_intervals(_band(spark, d), 0.9, K)
    return df.select(*[F.round(c, 4 if c in ("MIS", "PREDICTION_BAND_WIDTH") else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("metrics_preaggregated", f"WITH {_BAND}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) - 1 AS r, count(*) OVER (PARTITION BY series) AS n FROM b), g AS (SELECT series, sum(actual) AS a, sum(forecast) AS f FROM r WHERE r // 24 < n // 24 OR n < 24 GROUP BY series, r // 24) SELECT series, round(avg(abs(a - f)), 4) AS \"MAE\", round(sqrt(avg((a - f) ** 2)), 4) AS \"RMSE\" FROM g GROUP BY 1")
def _(spark, d):
    return rounded(m.evaluate_preaggregated(_band(spark, d), 24, keys=K), 4)


@query("r2_null_model", f'WITH {_BAND} SELECT is_test, round(1 - avg((actual - forecast) ** 2) / avg((actual - forecast_null) ** 2), 6) AS "R2_null_model_score" FROM b GROUP BY 1')
def _(spark, d):
    return rounded(m.evaluate_against_null(_band(spark, d), ["is_test"]), 6)


@query(
    "metrics_elementwise",
    f"WITH {_BAND} SELECT series, ts, round(actual - forecast, 4) AS residual, round(abs(actual - forecast), 4) AS absolute_error, round((actual - forecast) ** 2, 4) AS squared_error, round(100 * abs(actual - forecast) / nullif(abs(actual), 0), 4) AS absolute_percent_error, round(100 * abs(actual - forecast) / nullif(abs(actual) + abs(forecast), 0), 4) AS symmetric_percent_error, "
    "round(CASE WHEN actual < forecast THEN 0.2::DOUBLE * (forecast - actual) ELSE 0.8::DOUBLE * (actual - forecast) END, 4) AS pinball_80, (actual > lo AND actual < hi)::INTEGER::DOUBLE AS inside FROM b",
)
def _(spark, d):
    y, p = F.col("actual"), F.col("forecast")
    return rounded(_band(spark, d).select("series", "ts", *[f(y, p).alias(k) for k, f in m.ELEMENTWISE.items()], m.pinball(y, p, 0.8).alias("pinball_80"), m.within_bands(y, F.col("forecast_lower"), F.col("forecast_upper")).alias("inside")), 4)


@query("valid_rows", f"WITH {EG}, f AS (SELECT series, min(ts) AS t FROM eg WHERE y IS NOT NULL GROUP BY 1) SELECT eg.* FROM eg JOIN f USING (series) WHERE ts >= t")
def _(spark, d):
    return m.valid_rows(timegrid.fill_gaps(events_hourly(spark, d), "1 hour", K), ["y"], leading_only=True, keys=K)


@query("compare_frames", f"WITH {OD} SELECT a.ts, round((b.y - a.y) / abs(a.y), 6) AS y_diff FROM od a JOIN od b ON a.ts = b.ts WHERE a.series = 'F' AND b.series = 'O'")
def _(spark, d):
    o = orders_daily(spark, d)
    one = lambda s: o.filter(F.col("series") == s).select("ts", "y")
    return rounded(m.compare_frames(one("F"), one("O"), ["ts"], ["y"], relative=True))


@query("grouping_quantiles", f"WITH {OD} SELECT isodow(ts)::INTEGER AS dow, round(avg(y), 4) AS mean, round(quantile_cont(y, 0.1), 4) AS q10, round(quantile_cont(y, 0.9), 4) AS q90 FROM od GROUP BY 1")
def _(spark, d):
    q = evaluation.group_quantiles(cal.add_time_features(orders_daily(spark, d), ["dow"]), ["dow"], [0.1, 0.9])
    return rounded(q, 4)


@query("grouping_overlay", f"WITH {OD} SELECT isodow(ts)::INTEGER AS dow, round(avg(y) FILTER (WHERE series = 'F'), 4) AS \"F\", round(avg(y) FILTER (WHERE series = 'O'), 4) AS \"O\", round(avg(y) FILTER (WHERE series = 'P'), 4) AS \"P\" FROM od GROUP BY 1")
def _(spark, d):
    return rounded(evaluation.overlay(cal.add_time_features(orders_daily(spark, d), ["dow"]), "dow", "series", ["F", "O", "P"]), 4)


@query("sliding_block_metrics", f"WITH {_BAND}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS i, count(*) OVER (PARTITION BY series) AS n FROM b) SELECT series, ((i - 1 + (168 - n % 168) % 168) // 168)::BIGINT AS block, round(avg(abs(actual - forecast)), 4) AS \"MAE\" FROM r GROUP BY 1, 2")
def _(spark, d):
    return rounded(m.evaluate(evaluation.with_blocks(_band(spark, d), 168, K), ["series", "block"], ["MAE"]), 4)


# ---- rolling origins


@query(
    "rolling_splits",
    f"WITH {EG}, n AS (SELECT series, count(*) AS n FROM eg GROUP BY 1), k AS (SELECT series, n, unnest(range(0, 1000)) AS k FROM n) "
    "SELECT series, k AS back, (n - 24 - 24 * k)::BIGINT AS test_start, (n - 1 - 24 * k)::BIGINT AS test_end, 0::BIGINT AS train_start, (n - 25 - 24 * k)::BIGINT AS train_end FROM k WHERE n - 24 - 24 * k >= 336",
)
def _(spark, d):
    n = timegrid.fill_gaps(events_hourly(spark, d), "1 hour", K).groupBy("series").agg(F.count("*").alias("n"))
    return evaluation.split_table(n, 24, 336, 24)


@query(
    "moving_origin_eval",
    f"""WITH {EG}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series) AS n, isodow(ts) || '_' || strftime(ts, '%H') AS dow_hr FROM eg), k AS (SELECT unnest([0, 1, 2, 3]) AS back),
    t AS (SELECT series, back, dow_hr, avg(y) AS f FROM r CROSS JOIN k WHERE i < n - 24 - 24 * back GROUP BY 1, 2, 3), a AS (SELECT series, back, avg(y) AS f0 FROM r CROSS JOIN k WHERE i < n - 24 - 24 * back GROUP BY 1, 2),
    e AS (SELECT r.series, k.back, r.y AS actual, coalesce(t.f, a.f0) AS forecast FROM r CROSS JOIN k LEFT JOIN t ON t.series = r.series AND t.back = k.back AND t.dow_hr = r.dow_hr JOIN a ON a.series = r.series AND a.back = k.back WHERE i >= n - 24 - 24 * k.back AND i < n - 24 * k.back AND r.y IS NOT NULL)
    SELECT series, back::INTEGER AS back, round(avg(abs(actual - forecast)), 4) AS "MAE", round(sqrt(avg((actual - forecast) ** 2)), 4) AS "RMSE" FROM e GROUP BY 1, 2""",
)
def _(spark, d):
    g = cal.add_time_features(timegrid.fill_gaps(events_hourly(spark, d), "1 hour", K), ["dow_hr"])
    rolled = evaluation.with_rolling_roles(g, 24, 24, 4, K)
    train, test = rolled.filter("role = 'train'").drop("role"), rolled.filter("role = 'test'").drop("role")
    f = forecasters.similarity_forecast(train, test, ["dow_hr"], keys=["series", "back"]).withColumnRenamed("y", "actual").filter("actual is not null")
    return rounded(m.evaluate(f, ["series", "back"], ["MAE", "RMSE"]), 4)


@query(
    "grid_search_lag",
    f"""WITH {OG}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 28 AS is_test FROM og), c AS (SELECT unnest([7, 14, 28]) AS lag_days),
    e AS (SELECT r.series, lag_days, abs(r.y - p.y) AS e FROM r CROSS JOIN c JOIN r p ON p.series = r.series AND p.ts = r.ts - to_days(lag_days::INTEGER) WHERE r.is_test AND r.y IS NOT NULL AND p.y IS NOT NULL),
    s AS (SELECT series, lag_days, avg(e) AS mae FROM e GROUP BY 1, 2) SELECT series, lag_days::INTEGER AS lag_days, round(mae, 4) AS mae, rank() OVER (PARTITION BY series ORDER BY mae)::INTEGER AS rank, rank() OVER (PARTITION BY series ORDER BY mae) = 1 AS best FROM s""",
)
def _(spark, d):
    g = timegrid.train_test_split(daily_grid(spark, d), 28, K)
    grid = spark.createDataFrame([(7,), (14,), (28,)], "lag_days int")
    asked = g.filter("is_test and y is not null").crossJoin(F.broadcast(grid)).withColumn("t", F.col("ts") - F.make_dt_interval(F.col("lag_days")))
    joined = asked.join(g.select("series", F.col("ts").alias("t"), F.col("y").alias("forecast")), ["series", "t"]).withColumnRenamed("y", "actual").filter("forecast is not null")
    scored = m.evaluate(joined, ["series", "lag_days"], ["MAE"]).withColumnRenamed("MAE", "mae")
    return rounded(evaluation.rank_configs(scored, "mae", ["series"], ["lag_days"]), 4)


# ---- events

_HOL_YEARS = range(1995, 2002)
_ROWS = [(events.key_of(n), events._date(r, y)) for y in _HOL_YEARS for n, r in events._RULES["US"].items()]
_HV = "hv(event_key, date) AS (VALUES " + ", ".join(f"('{k}', DATE '{x}')" for k, x in _ROWS) + ")"


def _us(spark):
    return events.event_keys(events.holidays(spark, ["US"], 1995, 2001), list(events._RULES["US"]))


@query("holiday_table", f"WITH {_HV} SELECT event_key, date, 'event' AS event_name FROM hv WHERE date IN (SELECT o_orderdate::DATE FROM orders)")
def _(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return _us(spark).join(days, "date", "left_semi").select("event_key", "date", "event_name")


_OFF = "SELECT event_key, date, o, date + o AS day FROM hv CROSS JOIN (SELECT unnest([-2, -1, 0, 1]) AS o)"


@query(
    "event_window",
    f"WITH {_HV}, w AS ({_OFF}) SELECT CASE WHEN o < 0 THEN event_key || '_minus_' || (-o) WHEN o > 0 THEN event_key || '_plus_' || o ELSE event_key END AS event_key, count(*) AS n_orders FROM w JOIN orders ON o_orderdate::DATE = day GROUP BY 1",
)
def _(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return days.join(events.expand_window(_us(spark), 2, 1), "date").groupBy("event_key").agg(F.count("*").alias("n_orders"))


@query(
    "event_indicators",
    f"""WITH {OD}, {_HV} SELECT series, ts, CASE WHEN EXISTS (SELECT 1 FROM hv WHERE event_key = 'Christmas_Day' AND date = ts::DATE) THEN 'event' ELSE '' END AS "events_Christmas_Day",
    CASE WHEN EXISTS (SELECT 1 FROM hv WHERE event_key = 'Christmas_Day' AND date + 1 = ts::DATE) THEN 'event' ELSE '' END AS "events_Christmas_Day_plus_1", EXISTS (SELECT 1 FROM hv WHERE event_key = 'Christmas_Day' AND (date = ts::DATE OR date + 1 = ts::DATE))::INTEGER AS is_event,
    EXISTS (SELECT 1 FROM hv WHERE event_key = 'Christmas_Day' AND date = ts::DATE)::INTEGER AS is_event_exact, EXISTS (SELECT 1 FROM hv WHERE event_key = 'Christmas_Day' AND date + 1 = ts::DATE)::INTEGER AS is_event_adjacent FROM od""",
)
def _(spark, d):
    wide = events.expand_window(_us(spark), 0, 1)
    return events.add_events(orders_daily(spark, d), wide, ["Christmas_Day", "Christmas_Day_plus_1"]).select("series", "ts", "events_Christmas_Day", "events_Christmas_Day_plus_1", "is_event", "is_event_exact", "is_event_adjacent")


_SCORES = f"""{_HV}, dv AS (SELECT o_orderdate::DATE AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1), st AS (SELECT unnest([-7, 7]) AS o), n AS (SELECT unnest([1, 2, 3, 4]) AS n),
 c AS (SELECT event_key, date, o, n, date + o * n AS base, (date + o * n) IN (SELECT date FROM hv) AS busy FROM hv CROSS JOIN st CROSS JOIN n), b AS (SELECT event_key, date, o, arg_min(base, n) AS base FROM c WHERE NOT busy OR n = 4 GROUP BY 1, 2, 3),
 m AS (SELECT event_key, b.date, avg(v) AS baseline FROM b LEFT JOIN dv ON dv.date = base GROUP BY 1, 2), sc AS (SELECT event_key, m.date, v - baseline AS score FROM m JOIN dv USING (date))"""


@query("holiday_scores", f"WITH {_SCORES} SELECT event_key, date, round(score, 3) AS score FROM sc")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").cast("decimal(18,2)").alias("y"))
    s = events.holiday_scores(o, _us(spark))
    return s.select("event_key", "date", F.round(F.col("score").cast("double"), 3).alias("score"))


@query(
    "significant_holidays",
    f"WITH {_SCORES}, a AS (SELECT event_key, avg(score) AS s, count(score) AS n FROM sc GROUP BY 1), w AS (SELECT *, coalesce(sum(abs(s)) OVER (ORDER BY abs(s) DESC, event_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(abs(s)) OVER () AS total FROM a WHERE s IS NOT NULL) "
    "SELECT event_key, n AS n_days, round(s, 2) AS avg_score, CASE WHEN before < 0.8 * total THEN 'separate' WHEN before >= 0.99 * total THEN 'none' WHEN s > 0 THEN 'positive' ELSE 'negative' END AS role FROM w",
)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y"))
    a = events.significant_events(events.average_scores(events.holiday_scores(o, _us(spark))))
    return a.select("event_key", "n_days", F.round("avg_score", 2).alias("avg_score"), "role")
