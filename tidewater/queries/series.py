"""Models of many series in one job: keyed fits, rows around training, stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import multistage, series_models, timegrid
from tidewater.operators.linear_model import ModelSpec
from tidewater.queries._base import EG, OD, OG, events_hourly, money, orders_daily, query, rounded, table

K = ["series"]
#: The year with the elapsed share of it, at midnight.
CT = "(year({0}) + (dayofyear({0}) - 1) / CASE WHEN dayofyear(make_date(year({0}), 12, 31)) = 366 THEN 366.0 ELSE 365.0 END)"


def ols(**more) -> ModelSpec:
    return ModelSpec(**{"growth": "", "seasonality": {}, "algorithm": "ols", "params": {}} | more)


PER_SERIES = f"""
WITH {OG},
d AS (SELECT series, ts, y, {CT.format('ts')} AS ct, isodow(ts) AS dow FROM og),
m AS (SELECT series, dow, avg(ct) FILTER (WHERE y IS NOT NULL) AS mc, avg(y) AS my FROM d GROUP BY series, dow),
b AS (SELECT d.series, sum((ct - mc) * (y - my)) / sum((ct - mc) ^ 2) AS slope FROM d JOIN m USING (series, dow) WHERE y IS NOT NULL GROUP BY d.series),
f AS (SELECT series, unnest(generate_series(max(ts) + INTERVAL 1 DAY, max(ts) + INTERVAL 28 DAY, INTERVAL 1 DAY)) AS ts FROM og GROUP BY series)
SELECT f.series, f.ts, round(my + slope * ({CT.format('f.ts')} - mc), 4) AS forecast
FROM f JOIN m ON m.series = f.series AND m.dow = isodow(f.ts) JOIN b ON b.series = f.series
"""


@query("forecast_per_series", PER_SERIES)
def _(spark, d):
    """Trend and weekdays by least squares, one model for each order status, the next four weeks."""
    daily = timegrid.fill_gaps(orders_daily(spark, d), "1 day", K)
    models = series_models.fit_series(daily, ols(growth="ct1", extra_terms=["C(dow)"]), K)
    return rounded(series_models.predict_series(models, series_models.future_of(models, 28)).select("series", "ts", "forecast"), 4)


AROUND = f"""
WITH {OG},
n AS (SELECT series, ts, y, coalesce(y, first_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM og),
l AS (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY ts) AS x0 FROM n),
x AS (SELECT *, coalesce(x0, min(x0) OVER (PARTITION BY series)) AS x FROM l),
r AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, min(ts) AS t0, max(ts) AS t1, arg_min(v, ts) AS v0, arg_max(v, ts) AS v1 FROM x GROUP BY series),
q AS (
  SELECT series, ts, 'inside' AS part, a + b * x AS forecast FROM x JOIN r USING (series) WHERE day(ts) = 15
  UNION ALL SELECT series, t0 - k * INTERVAL 1 DAY, 'before', a + b * v0 FROM r, unnest(range(1, 11)) AS g(k)
  UNION ALL SELECT series, t1 + k * INTERVAL 1 DAY, 'after', a * (1 - b ^ k) / (1 - b) + b ^ k * v1 FROM r, unnest([5, 6, 9]) AS g(k))
SELECT series, ts, part, round(forecast, 4) AS forecast FROM q
"""


@query("predict_around_training", AROUND)
def _(spark, d):
    """Autoregression by one day: rows before training, every 15th of a month inside it, and rows after it with gaps, per series."""
    daily = timegrid.fill_gaps(orders_daily(spark, d), "1 day", K)
    models = series_models.fit_series(daily, ols(autoreg={"orders": [1]}), K)
    span = models.table.select("series", F.col("_first").alias("a"), F.col("_last").alias("b"))
    day = F.expr("interval 1 day")
    asked = span.select("series", F.explode(F.sequence(F.col("a") - day * 10, F.col("a") - day, day)).alias("ts"))
    asked = asked.unionByName(daily.filter(F.dayofmonth("ts") == 15).select("series", "ts"))
    asked = asked.unionByName(span.select("series", F.explode(F.array(*[F.col("b") + day * k for k in (5, 6, 9)])).alias("ts")))
    return rounded(series_models.predict_series(models, asked).select("series", "ts", "part", "forecast"), 4)


#: Rows of all but the last 48 hours, daily bins that are whole, and the rows of the last 48 hours.
STAGE_ROWS = f"""
{EG},
p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS back FROM eg),
te AS (SELECT series, ts FROM p WHERE back <= 48),
t AS (SELECT series, ts, y, max(ts) FILTER (WHERE y IS NOT NULL) OVER (PARTITION BY series) AS last FROM p WHERE back > 48),
tr AS (SELECT series, ts, y, last, date_trunc('day', ts)::TIMESTAMP AS bin FROM t WHERE ts <= last),
edge AS (SELECT series, date_trunc('day', min(ts) - INTERVAL 1 HOUR) AS lo, date_trunc('day', max(ts) + INTERVAL 1 HOUR) AS hi FROM tr GROUP BY series)"""
TWO = f"""
WITH {STAGE_ROWS},
d AS (SELECT tr.series, bin, avg(y) AS y, {CT.format('bin')} AS ct, isodow(bin) AS dow FROM tr JOIN edge USING (series) WHERE bin <> lo AND bin <> hi GROUP BY tr.series, bin),
m AS (SELECT series, dow, avg(ct) FILTER (WHERE y IS NOT NULL) AS mc, avg(y) AS my FROM d GROUP BY series, dow),
b AS (SELECT d.series, sum((ct - mc) * (y - my)) / sum((ct - mc) ^ 2) AS slope FROM d JOIN m USING (series, dow) WHERE y IS NOT NULL GROUP BY d.series),
s0 AS (
  SELECT x.series, x.bin, my + slope * ({CT.format('x.bin')} - mc) AS f
  FROM (SELECT DISTINCT series, bin FROM tr UNION SELECT DISTINCT series, date_trunc('day', ts)::TIMESTAMP FROM te) x
  JOIN m ON m.series = x.series AND m.dow = isodow(x.bin) JOIN b ON b.series = x.series),
s1 AS (SELECT tr.series, hour(ts) AS h, avg(y - f) AS f FROM tr JOIN s0 USING (series, bin) WHERE last - ts < INTERVAL 14 DAY GROUP BY tr.series, hour(ts))
SELECT te.series, te.ts, round(s0.f, 4) AS forecast_0, round(s1.f, 4) AS forecast_1, round(s0.f + s1.f, 4) AS forecast
FROM te JOIN s0 ON s0.series = te.series AND s0.bin = date_trunc('day', te.ts) JOIN s1 ON s1.series = te.series AND s1.h = hour(te.ts)
"""


def _hourly_split(spark, d):
    both = timegrid.train_test_split(timegrid.fill_gaps(events_hourly(spark, d), "1 hour", K), 48, K)
    return both.filter("not is_test").drop("is_test"), both.filter("is_test").select("series", "ts")


@query("multistage_two_stages", TWO)
def _(spark, d):
    """Trend and weekdays of daily means over the whole history, then hours of what is left in the last two weeks."""
    train, test = _hourly_split(spark, d)
    stages = [multistage.Stage(ols(extra_terms=["C(hour)"]), None, "14 days"), multistage.Stage(ols(growth="ct1", extra_terms=["C(dow)"]), "D")]
    model = multistage.fit_multistage(train, stages, "1 hour", K)
    return rounded(multistage.predict_multistage(model, test).select("series", "ts", "forecast_0", "forecast_1", "forecast"), 4)


THREE = f"""
WITH {STAGE_ROWS},
d0 AS (SELECT tr.series, bin, avg(y) AS y, {CT.format('bin')} AS ct FROM tr JOIN edge USING (series) WHERE bin <> lo AND bin <> hi GROUP BY tr.series, bin),
b0 AS (SELECT series, regr_slope(y, ct) AS b, regr_intercept(y, ct) AS a FROM d0 GROUP BY series),
r1 AS (SELECT tr.series, ts, bin, last, y - (a + b * {CT.format('bin')}) AS y FROM tr JOIN b0 USING (series)),
w1 AS (SELECT * FROM r1 WHERE last - ts < INTERVAL 21 DAY),
e1 AS (SELECT series, date_trunc('day', min(ts) - INTERVAL 1 HOUR) AS lo, date_trunc('day', max(ts) + INTERVAL 1 HOUR) AS hi FROM w1 GROUP BY series),
d1 AS (SELECT w1.series, bin, avg(y) AS y FROM w1 JOIN e1 USING (series) WHERE bin <> lo AND bin <> hi GROUP BY w1.series, bin),
s1 AS (SELECT series, isodow(bin) AS dow, avg(y) AS f FROM d1 GROUP BY series, isodow(bin)),
s2 AS (SELECT r1.series, hour(ts) AS h, avg(y - f) AS f FROM r1 JOIN s1 ON s1.series = r1.series AND s1.dow = isodow(r1.bin) WHERE last - ts < INTERVAL 7 DAY GROUP BY r1.series, hour(ts))
SELECT te.series, te.ts, round(a + b * {CT.format("date_trunc('day', te.ts)")}, 4) AS forecast_0, round(s1.f, 4) AS forecast_1, round(s2.f, 4) AS forecast_2,
       round(a + b * {CT.format("date_trunc('day', te.ts)")} + s1.f + s2.f, 4) AS forecast
FROM te JOIN b0 ON b0.series = te.series JOIN s1 ON s1.series = te.series AND s1.dow = isodow(te.ts) JOIN s2 ON s2.series = te.series AND s2.h = hour(te.ts)
"""


@query("multistage_three_stages", THREE)
def _(spark, d):
    """Daily trend, weekdays of the last three weeks, hours of the last week."""
    train, test = _hourly_split(spark, d)
    stages = [multistage.Stage(ols(growth="ct1"), "D"), multistage.Stage(ols(extra_terms=["C(dow)"]), "D", "21 days"), multistage.Stage(ols(extra_terms=["C(hour)"]), None, "7 days")]
    model = multistage.fit_multistage(train, stages, "1 hour", K)
    return rounded(multistage.predict_multistage(model, test).select("series", "ts", "forecast_0", "forecast_1", "forecast_2", "forecast"), 4)


#: Splits by rows from the end: three test days, the last first.
SEARCH = f"""
WITH {EG},
n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) - 1 AS back,
             coalesce(y, first_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM eg),
l AS (SELECT *, lag(v, 24) OVER (PARTITION BY series ORDER BY ts) AS x0 FROM n),
s AS (SELECT unnest([0, 1, 2]) AS split),
tr AS (SELECT l.*, split, coalesce(x0, min(x0) OVER (PARTITION BY series, split)) AS x FROM l, s WHERE back >= 24 * (split + 1)),
te AS (SELECT l.*, split FROM l, s WHERE back >= 24 * split AND back < 24 * (split + 1) AND y IS NOT NULL),
h AS (SELECT series, split, hour(ts) AS h, avg(y) AS f FROM tr GROUP BY ALL),
d AS (SELECT series, split, isodow(ts) AS d, avg(y) AS f FROM tr GROUP BY ALL),
r AS (SELECT series, split, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM tr WHERE y IS NOT NULL GROUP BY ALL),
p AS (
  SELECT te.series, te.split, 0 AS config, y, f FROM te JOIN h ON h.series = te.series AND h.split = te.split AND h.h = hour(te.ts)
  UNION ALL SELECT te.series, te.split, 1, y, f FROM te JOIN d ON d.series = te.series AND d.split = te.split AND d.d = isodow(te.ts)
  UNION ALL SELECT te.series, te.split, 2, y, a + b * x0 FROM te JOIN r ON r.series = te.series AND r.split = te.split)
SELECT series, config::INT AS config, split::INT AS split, round(avg(abs(y - f)), 4) AS "MAE", round(sqrt(avg((y - f) ^ 2)), 4) AS "RMSE" FROM p GROUP BY series, config, split
"""


@query("rolling_search", SEARCH)
def _(spark, d):
    """Hours, weekdays or the value a day before: errors on three test days of each series."""
    from tidewater.operators import rolling_search

    grid = timegrid.fill_gaps(events_hourly(spark, d), "1 hour", K)
    specs = [ols(extra_terms=["C(hour)"]), ols(extra_terms=["C(dow)"]), ols(autoreg={"orders": [24]})]
    splits = [rolling_search.Split(24 * k, 24, 24 * (k + 1)) for k in range(3)]
    return rounded(rolling_search.rolling_scores(grid, specs, splits, K), 4)


@query("forecaster_by_status")
def _(spark, d):
    """The entry point over order statuses as keys: automatic template, search over rolling origins, backtest and forecast."""
    from tidewater.plans.api import Forecaster
    from tidewater.plans.config import ForecastConfig, Metadata

    config = ForecastConfig(horizon=30, metadata=Metadata(keys=["series"], freq="D"))
    return rounded(Forecaster().run(orders_daily(spark, d), config).forecast.select("series", "ts", "forecast", "forecast_lower", "forecast_upper"), 4)


@query("forecaster_five_minutes")
def _(spark, d):
    """The entry point on a month of five-minute sums of all events."""
    from tidewater.plans.api import Forecaster
    from tidewater.plans.config import ForecastConfig, Metadata

    e = spark.read.parquet(f"{d}/events.parquet")
    bins = e.groupBy(F.window("ts", "5 minutes").start.cast("timestamp_ntz").alias("ts")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("y"))
    return rounded(Forecaster().run(bins, ForecastConfig(horizon=12, metadata=Metadata(freq="5min"))).forecast.select("ts", "forecast", "forecast_lower", "forecast_upper"), 4)


LAG_CORR = f"""
WITH {EG},
p AS (SELECT ts, max(y) FILTER (WHERE series = 'view') AS x, max(y) FILTER (WHERE series = 'purchase') AS z, max(y) FILTER (WHERE series = 'click') AS y FROM eg GROUP BY ts),
l AS (SELECT y, r, k, CASE r WHEN 'x' THEN lag(x, k) OVER w ELSE lag(z, k) OVER w END AS v FROM p, unnest(['x', 'z']) AS a(r), unnest([1, 2, 24, 25, 48, 168]) AS b(k) WINDOW w AS (PARTITION BY r, k ORDER BY ts)),
c AS (SELECT r AS regressor, k::INT AS lag, count(y + v) AS n, corr(y, v) AS c FROM l GROUP BY r, k)
SELECT regressor, lag, n, round(c, 6) AS correlation, row_number() OVER (PARTITION BY regressor ORDER BY abs(c) DESC, lag)::INT AS rank FROM c WHERE lag >= 24
"""


@query("lagged_regressor_choice", LAG_CORR)
def _(spark, d):
    """How clicks of an hour go with views and purchases of earlier hours: lags beyond a day's horizon, best first."""
    from tidewater.operators import lags

    grid = timegrid.fill_gaps(events_hourly(spark, d), "1 hour", K)
    one = lambda s: F.max(F.when(F.col("series") == s, F.col("y")))
    wide = grid.groupBy("ts").agg(one("view").alias("x"), one("purchase").alias("z"), one("click").alias("y"))
    found = lags.lagged_correlations(wide, ["x", "z"], [1, 2, 24, 25, 48, 168])
    return rounded(lags.best_lags(found, 24, most=6), 6)


GLM = """
WITH g AS (SELECT (l_returnflag = 'R')::INT AS f, l_extendedprice::DOUBLE AS y FROM lineitem),
m AS (SELECT avg(y) FILTER (WHERE f = 0) AS m0, avg(y) FILTER (WHERE f = 1) AS m1, count(*) FILTER (WHERE f = 0) AS n0, count(*) FILTER (WHERE f = 1) AS n1 FROM g),
d AS (SELECT sum((y / CASE f WHEN 1 THEN m1 ELSE m0 END - 1) ^ 2) / (count(*) - 2) AS phi FROM g, m),
r AS (SELECT 'Intercept' AS term, ln(m0) AS b, sqrt(phi / n0) AS s FROM m, d UNION ALL SELECT 'returned', ln(m1) - ln(m0), sqrt(phi / n0 + phi / n1) FROM m, d)
SELECT term, round(b, 6) AS estimate, round(s, 6) AS std_err, round(b / s, 4) AS z FROM r
"""


@query("gamma_coefficients", GLM)
def _(spark, d):
    """Prices of line items by a gamma model with log link and one indicator: coefficients with errors."""
    from tidewater.operators import glm

    items = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("x"))
    fit = glm.fit_glm(items, {"Intercept": F.lit(1.0), "returned": F.col("x")}, F.col("y"), "gamma")
    rows = [(r["term"], round(r["estimate"], 6), round(r["std_err"], 6), round(r["z"], 4)) for r in glm.glm_summary(fit)]  # two coefficients
    return spark.createDataFrame(rows, "term string, estimate double, std_err double, z double")


GROUPS = f"""
WITH {OG},
e AS (SELECT series, strftime(ts, '%m-%d') AS event_key, avg(y::DECIMAL(18,2)) AS s FROM og GROUP BY ALL),
o AS (SELECT series, avg(y::DECIMAL(18,2)) AS m FROM og GROUP BY series),
a AS (SELECT e.series, event_key, e.s - o.m AS avg_score FROM e JOIN o USING (series) WHERE e.s IS NOT NULL),
x AS (SELECT DISTINCT series, avg_score AS x FROM a),
h AS (SELECT series, 0.9 * least(stddev_pop(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * count(*) ^ (-0.2) * 0.2 AS h FROM x GROUP BY series),
d AS (SELECT p.series, p.x, sum(exp(-0.5 * ((p.x - q.x) / h) ^ 2)) AS d FROM x p JOIN x q ON q.series = p.series JOIN h ON h.series = p.series GROUP BY p.series, p.x),
n AS (SELECT *, lag(d) OVER w AS before, lead(d) OVER w AS after FROM d WINDOW w AS (PARTITION BY series ORDER BY x)),
c AS (SELECT series, x FROM n WHERE d < before AND d < after UNION SELECT DISTINCT series, 0.0::DOUBLE FROM a),
r AS (SELECT a.series, event_key, avg_score, count(c.x) FILTER (WHERE c.x < avg_score) AS part FROM a JOIN c ON c.series = a.series GROUP BY ALL)
SELECT series, event_key, round(avg_score, 2) AS avg_score, (dense_rank() OVER (PARTITION BY series ORDER BY part) - 1)::INT AS "group" FROM r
"""


@query("event_groups_by_density", GROUPS)
def _(spark, d):
    """Days of the year by their effect on each order status, grouped at the valleys of the effects' density."""
    from tidewater.operators import events

    daily = timegrid.fill_gaps(orders_daily(spark, d), "1 day", K)
    exact = F.avg(F.col("y").cast("decimal(18,2)")).cast("double")
    overall = daily.groupBy("series").agg(exact.alias("m"))
    effects = daily.groupBy("series", F.date_format("ts", "MM-dd").alias("event_key")).agg(exact.alias("s")).filter("s is not null")
    averages = effects.join(overall, "series").select("series", "event_key", (F.col("s") - F.col("m")).alias("avg_score"))
    return events.group_by_density(averages, K).select("series", "event_key", F.round("avg_score", 2).alias("avg_score"), "group")


#: Weekdays free before 1998, what they add up to afterwards constrained to the same mean: least squares by one multiplier.
REGIMES = f"""
WITH {OG},
d AS (SELECT series, ts, y, isodow(ts) AS dow, (ts >= TIMESTAMP '1998-01-01')::INT AS late FROM og),
m AS (SELECT series, dow, avg(y) FILTER (WHERE late = 0) AS a, avg(y) FILTER (WHERE late = 1) AS b, count(y) FILTER (WHERE late = 0) AS n, count(y) FILTER (WHERE late = 1) AS k FROM d GROUP BY series, dow),
c AS (SELECT series, sum(b - a) / sum(1.0 / n + 1.0 / k) AS c FROM m GROUP BY series),
f AS (SELECT series, dow, a + c / n AS early, b - c / k AS later FROM m JOIN c USING (series)),
i AS (SELECT series, avg(early) AS mean FROM f GROUP BY series)
SELECT d.series, d.ts, round(mean, 3) AS trend, round(CASE late WHEN 0 THEN early ELSE later END - mean, 3) AS weekly
FROM d JOIN f ON f.series = d.series AND f.dow = d.dow JOIN i ON i.series = d.series
"""


@query("seasonality_regimes", REGIMES)
def _(spark, d):
    """The week of each order status before and from 1998 on, as components of one fit."""
    import datetime as dt

    from tidewater.operators import series_models

    daily = timegrid.fill_gaps(orders_daily(spark, d), "1 day", K)
    spec = ols(seasonality={"weekly": 3}, seasonality_changepoints={"weekly": [dt.datetime(1998, 1, 1)]})
    parts = series_models.fitted_components(series_models.fit_series(daily, spec, K), {"weekly": ".*_weekly"})
    return rounded(parts.select("series", "ts", F.col("Intercept").alias("trend"), "weekly"), 3)


#: Adaptive lasso with one regressor in closed form: least squares shrunk by what the penalty takes of the covariance of all rows.
LASSO_CV = f"""
WITH {OD},
d AS (SELECT ts, sum(y) / 1000000 AS y, (ts::DATE - DATE '1992-01-01') / 365.25 AS x FROM od GROUP BY ts),
f AS (SELECT year(ts) % 4 AS fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM d GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM f),
a AS (SELECT n, sx / n AS mx, sy / n AS my, sxx / n - (sx / n) ** 2 AS vx, sxy / n - sx * sy / n / n AS vxy FROM t),
g AS (SELECT s / 20.0 AS strength, 10.0 ** (6 * (s / 20.0 - 1)) AS share FROM generate_series(1, 20) AS x(s)),
r AS (SELECT f.*, t.n - f.n AS m, (t.sx - f.sx) / (t.n - f.n) AS mx, (t.sy - f.sy) / (t.n - f.n) AS my, (t.sxx - f.sxx) / (t.n - f.n) AS qxx, (t.sxy - f.sxy) / (t.n - f.n) AS qxy FROM f, t),
b AS (SELECT g.strength, r.*, sign(qxy - r.mx * r.my) * greatest(abs(qxy - r.mx * r.my) - share * abs(a.vxy), 0) / (qxx - r.mx ** 2) AS b FROM g, r, a),
l AS (SELECT strength, sum((syy - 2 * (my - b * mx) * sy - 2 * b * sxy + n * (my - b * mx) ** 2 + 2 * b * (my - b * mx) * sx + b * b * sxx) / n) AS loss FROM b GROUP BY strength)
SELECT l.strength, round(loss, 8) AS loss, strength = (SELECT max(strength) FROM l WHERE loss <= (SELECT min(loss) FROM l) + 1e-12) AS chosen, round(vxy / vx * (1 - share), 8) AS slope
FROM l JOIN g USING (strength), a
"""


@query("lasso_strengths", LASSO_CV)
def _(spark, d):
    """How strongly a trend is held down: loss on held-out years and slope per strength, and which strength is chosen."""
    from tidewater.operators import regression

    daily = orders_daily(spark, d).groupBy("ts").agg((F.sum("y") / 1000000).alias("y"))
    x = F.datediff(F.col("ts"), F.lit("1992-01-01").cast("date")) / 365.25
    columns = {"Intercept": F.lit(1.0), "x": x}
    parts = regression.gram_table(daily.withColumn("fold", F.year("ts") % 4), list(columns.values()), F.col("y"), keys=["fold"]).collect()  # one matrix per fold
    folds = [regression.gram_from(r.sums, list(columns)) for r in parts]
    fit = regression.fit_adaptive_lasso_cv(folds, [k / 20 for k in range(1, 21)])
    total = regression.total_of(folds)
    rows = [(s, round(loss, 8), s == fit.params["strength"], round(regression.fit_adaptive_lasso(total, strength=s).coefficients()["x"], 8)) for s, loss in fit.params["losses"].items()]
    return spark.createDataFrame(rows, "strength double, loss double, chosen boolean, slope double")


#: Least squares over three levels by hand: inner nodes join their own value with their children's sum by precision.
TREE = """
WITH v AS (SELECT year(o_orderdate) AS y, c_nationkey AS n, n_regionkey AS r, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 1000 AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
leaf AS (SELECT y + 1 AS y, n, r, v FROM v), reg AS (SELECT y + 2 AS y, r, sum(v) AS v FROM v GROUP BY ALL), top AS (SELECT y + 1 AS y, sum(v) * 1.05 AS v FROM v GROUP BY ALL),
size AS (SELECT n_regionkey AS r, count(*) AS k FROM nation GROUP BY 1), every AS (SELECT count(*) AS k FROM nation),
s AS (SELECT leaf.y, leaf.r, sum(leaf.v) AS s, count(*) AS k FROM leaf GROUP BY 1, 2),
u AS (SELECT s.y, s.r, s.s, s.k AS var, 1.0 / s.k AS w, reg.v FROM s JOIN size ON size.r = s.r AND size.k = s.k LEFT JOIN reg ON reg.y = s.y AND reg.r = s.r),
m AS (SELECT *, CASE WHEN v IS NULL THEN s ELSE (w * v + s / var) / (w + 1.0 / var) END AS m, CASE WHEN v IS NULL THEN var ELSE 1 / (w + 1.0 / var) END AS mv FROM u),
a AS (SELECT m.y, sum(m) AS s, sum(mv) AS var FROM m GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM size)),
t AS (SELECT a.y, a.s, a.var, CASE WHEN top.v IS NULL THEN a.s ELSE (top.v / k + a.s / a.var) / (1.0 / k + 1.0 / a.var) END AS x FROM a CROSS JOIN every LEFT JOIN top USING (y)),
x AS (SELECT m.y, m.r, m.s, m.var, m.m + m.mv / t.var * (t.x - t.s) AS x FROM m JOIN t ON t.y = m.y)
SELECT y, 'all' AS node, round(x, 3) AS value FROM t
UNION ALL SELECT y, 'r' || r, round(x, 3) FROM x
UNION ALL SELECT x.y, 'n' || leaf.n, round(leaf.v + (x.x - x.s) / x.var, 3) FROM leaf JOIN x ON x.y = leaf.y AND x.r = leaf.r
"""


@query("reconcile_tree", TREE)
def _(spark, d):
    """Naive forecasts of nations, regions and all of a year's orders, of different lags, made to add up; weights by size."""
    from tidewater.operators import tree_reconcile

    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    year = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    v = year.groupBy(F.year("o_orderdate").alias("y"), "n_nationkey", "n_regionkey").agg((money("o_totalprice") / 1000).alias("v"))
    of = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    leaves = v.select((F.col("y") + 1).alias("y"), of("n", "n_nationkey").alias("node"), F.col("v").alias("value"))
    regions = v.groupBy((F.col("y") + 2).alias("y"), of("r", "n_regionkey").alias("node")).agg(F.sum("v").alias("value"))
    top = v.groupBy((F.col("y") + 1).alias("y"), F.lit("all").alias("node")).agg((F.sum("v") * 1.05).alias("value"))
    edges = nation.select(of("n", "n_nationkey").alias("node"), of("r", "n_regionkey").alias("parent")).unionByName(nation.select(of("r", "n_regionkey").alias("node"), F.lit("all").alias("parent")).distinct())
    out = tree_reconcile.reconcile_tree(leaves.unionByName(regions).unionByName(top), edges, "structural", ["y"])
    return rounded(out.filter("value IS NOT NULL"), 3)
