"""Queries of labels, detectors, changepoints, regression and reconciliation."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tidewater.functions import calendar as cal
from tidewater.operators import changepoints, detect, evaluation, events, forecasters, labels, linear_model, reconcile, regression, seasonality, timegrid
from tidewater.queries._base import OD, OG, events_hourly, money, orders_daily, query, rounded, table
from tidewater.queries.further import BENCHMARK, STAGES
from tidewater.queries.modelling import SIM, similarity

K = ["series"]

LAB = SIM + (
    ", st AS (SELECT series, avg(actual) AS m, stddev_samp(actual) AS sd FROM sim WHERE actual IS NOT NULL GROUP BY 1), "
    "lab AS (SELECT series, ts, actual, forecast, dow_hr, actual > m + 1.5 * sd AS is_anomaly, coalesce(100 * abs(actual - forecast) / nullif(abs(actual), 0) > 40, FALSE) AS is_anomaly_predicted FROM sim JOIN st USING (series) WHERE actual IS NOT NULL)"
)


def labelled(spark, d):
    s = similarity(spark, d).filter("actual is not null")
    st = s.groupBy("series").agg(F.avg("actual").alias("m"), F.stddev_samp("actual").alias("sd"))
    ape = 100 * F.abs(F.col("actual") - F.col("forecast")) / F.nullif(F.abs("actual"), F.lit(0.0))
    return s.join(st, "series").select("series", "ts", "actual", "forecast", "dow_hr", (F.col("actual") > F.col("m") + 1.5 * F.col("sd")).alias("is_anomaly"), F.coalesce(ape > 40, F.lit(False)).alias("is_anomaly_predicted"))


_ISLANDS = "SELECT series, ts, pos, pos - row_number() OVER (PARTITION BY series ORDER BY ts) AS g FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS pos FROM lab) WHERE {}"


@query("anomaly_intervals", f"WITH {LAB}, i AS ({_ISLANDS.format('is_anomaly_predicted')}) SELECT series, min(ts) AS start_time, max(ts) AS end_time FROM i GROUP BY series, g")
def _(spark, d):
    return labels.label_to_intervals(labelled(spark, d), "is_anomaly_predicted", K)


@query(
    "merge_intervals",
    f"WITH {LAB}, i AS ({_ISLANDS.format('is_anomaly_predicted')}), v AS (SELECT series, min(ts) AS s, max(ts) AS e FROM i GROUP BY series, g), r AS (SELECT *, max(e) OVER (PARTITION BY series ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v), "
    "f AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY s, e) AS grp FROM r) SELECT series, min(s) AS start_time, max(e) AS end_time FROM f GROUP BY series, grp",
)
def _(spark, d):
    return labels.merge_intervals(labels.label_to_intervals(labelled(spark, d), "is_anomaly_predicted", K), "3 hours", K)


@query("confusion_matrix", f"WITH {LAB} SELECT series, is_anomaly, is_anomaly_predicted, count(*) AS n FROM lab GROUP BY ALL")
def _(spark, d):
    return labels.confusion(labelled(spark, d), K)


_R = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"


@query(
    "label_metrics",
    f"""WITH {LAB}, c AS (SELECT series, count(*) FILTER (WHERE is_anomaly AND is_anomaly_predicted) AS tp, count(*) FILTER (WHERE NOT is_anomaly AND is_anomaly_predicted) AS fp, count(*) FILTER (WHERE is_anomaly AND NOT is_anomaly_predicted) AS fn, count(*) FILTER (WHERE NOT is_anomaly AND NOT is_anomaly_predicted) AS tn FROM lab GROUP BY 1)
    SELECT series, tp, fp, fn, tn, round({_R("tp", "tp + fp")}, 6) AS precision, round({_R("tp", "tp + fn")}, 6) AS recall, round({_R("2 * tp", "2 * tp + fp + fn")}, 6) AS f1, round({_R("tn", "tn + fn")}, 6) AS precision_0, round({_R("tn", "tn + fp")}, 6) AS recall_0, round({_R("2 * tn", "2 * tn + fp + fn")}, 6) AS f1_0,
    round({_R("tp * tn - fp * fn", "sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))")}, 6) AS mcc, round({_R("tp", "tp + fn")} + {_R("tn", "tn + fp")} - 1, 6) AS informedness FROM c""",
)
def _(spark, d):
    return rounded(labels.label_metrics(labelled(spark, d), K))


@query(
    "soft_metrics",
    f"""WITH {LAB}, n AS (SELECT *, bool_or(is_anomaly) OVER w AS t, bool_or(is_anomaly_predicted) OVER w AS p FROM lab WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    s AS (SELECT series, {_R("count(*) FILTER (WHERE is_anomaly AND p)", "count(*) FILTER (WHERE is_anomaly)")} AS r, {_R("count(*) FILTER (WHERE is_anomaly_predicted AND t)", "count(*) FILTER (WHERE is_anomaly_predicted)")} AS q FROM n GROUP BY 1)
    SELECT series, round(r, 6) AS soft_recall, round(q, 6) AS soft_precision, round(CASE WHEN r + q > 0 THEN 2 * r * q / (r + q) END, 6) AS soft_f1 FROM s""",
)
def _(spark, d):
    return rounded(labels.soft_metrics(labelled(spark, d), 2, K))


def _range_sql(side: str, other: str, reward: str, name: str) -> str:
    return f"""WITH {LAB}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS pos, {other} AND NOT coalesce(lag({other}) OVER (PARTITION BY series ORDER BY ts), FALSE) AS begins FROM lab),
    g AS (SELECT *, pos - row_number() OVER (PARTITION BY series ORDER BY ts) AS g FROM p WHERE {side}), r AS (SELECT *, row_number() OVER (PARTITION BY series, g ORDER BY ts) AS i, count(*) OVER (PARTITION BY series, g) AS len FROM g),
    e AS (SELECT series, g, count(*) FILTER (WHERE begins OR (i = 1 AND {other} AND NOT begins)) AS met, sum(CASE WHEN {other} THEN {reward} ELSE 0 END)::DOUBLE AS got, sum({reward})::DOUBLE AS every FROM r GROUP BY 1, 2)
    SELECT series, round(avg(0.5 * (met > 0)::INTEGER + 0.5 * (CASE WHEN met > 1 THEN 1.0 / met ELSE 1.0 END) * got / every), 6) AS {name} FROM e GROUP BY 1"""


for _bias, _reward in {"flat": "1", "front": "(len - i + 1)", "middle": "(CASE WHEN i <= len / 2.0 THEN i ELSE len - i + 1 END)", "back": "i"}.items():

    @query(f"range_precision_{_bias}", _range_sql("is_anomaly_predicted", "is_anomaly", _reward, "range_precision"))
    def _(spark, d, bias=_bias):
        return rounded(labels.range_precision(labelled(spark, d), alpha=0.5, bias=bias, cardinality="reciprocal", keys=K))

    @query(f"range_recall_{_bias}", _range_sql("is_anomaly", "is_anomaly_predicted", _reward, "range_recall"))
    def _(spark, d, bias=_bias):
        return rounded(labels.range_recall(labelled(spark, d), alpha=0.5, bias=bias, cardinality="reciprocal", keys=K))


# ---- detectors

_F1 = "CASE WHEN count(*) FILTER (WHERE is_anomaly) + count(*) FILTER (WHERE p) > 0 THEN 2.0::DOUBLE * count(*) FILTER (WHERE is_anomaly AND p) / (count(*) FILTER (WHERE is_anomaly) + count(*) FILTER (WHERE p)) ELSE 0 END"


@query(
    "ape_detector_grid",
    f"WITH {LAB}, th AS (SELECT unnest([20.0, 40.0, 60.0, 80.0, 100.0]) AS threshold), x AS (SELECT series, threshold::DOUBLE AS threshold, is_anomaly, coalesce(100 * abs(actual - forecast) / nullif(abs(actual), 0) > threshold, FALSE) AS p FROM lab CROSS JOIN th) SELECT series, threshold, round({_F1}, 6) AS reward FROM x GROUP BY 1, 2",
)
def _(spark, d):
    rows = labelled(spark, d).withColumn("ape", detect.ape([F.col("actual")], [F.col("forecast")]))
    grid = detect.param_grid(spark, {"threshold": [20.0, 40.0, 60.0, 80.0, 100.0]})
    return rounded(detect.score_grid(rows, grid, F.col("ape") > F.col("threshold"), detect.F1, keys=K).drop("param_id"))


_COV = [0.5, 0.8, 0.9, 0.95, 0.99]
_ZV = ", ".join(f"({k}, {c}::DOUBLE, {NormalDist().inv_cdf(0.5 + c / 2)!r}::DOUBLE)" for k, c in enumerate(_COV))


@query(
    "detector_grid_best",
    f"""WITH {LAB}, z(id, coverage, z) AS (VALUES {_ZV}), sd AS (SELECT series, stddev_samp(actual - forecast) AS sd FROM lab GROUP BY 1), x AS (SELECT lab.series, id, coverage, is_anomaly, abs(actual - forecast) > z * sd AS p FROM lab JOIN sd USING (series) CROSS JOIN z),
    r AS (SELECT series, id, coverage, {_F1} AS reward FROM x GROUP BY 1, 2, 3) SELECT series, arg_max(coverage, (reward, -id)) AS coverage, round(max(reward), 6) AS reward FROM r GROUP BY 1""",
)
def _(spark, d):
    from tidewater.operators.intervals import slice_distributions

    rows = labelled(spark, d).withColumn("_r", F.col("actual") - F.col("forecast"))
    rows = rows.join(slice_distributions(rows, "_r", [0.5], K).select("series", "std"), "series")
    grid = detect.param_grid(spark, {"coverage": _COV})
    z = spark.createDataFrame([(c, NormalDist().inv_cdf(0.5 + c / 2)) for c in _COV], "coverage double, z double")
    scores = detect.score_grid(rows, grid.join(F.broadcast(z), "coverage").select("param_id", "coverage", "z"), F.abs("_r") > F.col("z") * F.col("std"), detect.F1, keys=K)
    return rounded(detect.best_params(scores, K).select("series", "coverage", "reward"))


@query("detector_fit_predict")
def _(spark, d):
    """Interval detector with coverage and slices chosen by reward, then intervals of what it predicts."""
    rows = cal.add_time_features(labelled(spark, d).drop("is_anomaly_predicted"), ["dow", "is_weekend"])
    found = detect.IntervalDetector(detect.config_reward("F1", min_recall=0.2), volatility=((), ("series",), ("series", "is_weekend"))).fit(rows).predict(rows)
    return labels.label_to_intervals(found, "is_anomaly_predicted", K)


@query("join_forecasts", f"WITH {LAB} SELECT series, ts, actual, round(forecast, 4) AS a_forecast, round(forecast * 1.1371, 4) AS b_forecast, round(100 * abs(actual - forecast) / nullif(abs(actual), 0), 4) AS ape FROM lab")
def _(spark, d):
    s = labelled(spark, d)
    both = detect.join_forecasts(s.select("series", "ts", "actual"), {"a": s, "b": s.withColumn("forecast", F.col("forecast") * 1.1371)}, ["series", "ts"])
    return rounded(both.withColumn("ape", detect.ape([F.col("actual")], [F.col("a_forecast")])), 4)


@query("anomaly_from_outliers", f"WITH {OD}, q AS (SELECT *, quantile_cont(y, 0.005) OVER (PARTITION BY series) AS a, quantile_cont(y, 0.995) OVER (PARTITION BY series) AS b FROM od), s AS (SELECT series, avg(y) AS m, stddev_pop(y) AS sd FROM q WHERE y BETWEEN a AND b GROUP BY 1), o AS (SELECT series, ts, abs((y - m) / sd) > 2 AS bad, row_number() OVER (PARTITION BY series ORDER BY ts) AS pos FROM od JOIN s USING (series)), i AS (SELECT *, pos - row_number() OVER (PARTITION BY series ORDER BY ts) AS g FROM o WHERE bad) SELECT series, min(ts) AS start_time, max(ts) AS end_time FROM i GROUP BY series, g")
def _(spark, d):
    return detect.anomaly_from_outliers(orders_daily(spark, d), "y", 2.0, keys=K)


# ---- changepoints, seasonality, regression


@query(
    "level_shifts",
    f"WITH {OD}, a AS (SELECT *, abs(y - lag(y) OVER w) AS d, row_number() OVER w AS pos FROM od WINDOW w AS (PARTITION BY series ORDER BY ts)), z AS (SELECT *, (d - avg(d) OVER (PARTITION BY series)) / stddev_samp(d) OVER (PARTITION BY series) AS z FROM a), i AS (SELECT *, pos - row_number() OVER (PARTITION BY series ORDER BY ts) AS g FROM z WHERE z > 3) SELECT series, min(ts) AS start_time, max(ts) AS end_time FROM i GROUP BY series, g",
)
def _(spark, d):
    return changepoints.level_shifts(orders_daily(spark, d), keys=K)


@query(
    "ols_trend_per_series",
    f"WITH {OD}, x AS (SELECT series, y, date_diff('day', DATE '1995-01-01', ts::DATE)::DOUBLE AS t FROM od) SELECT series, 'Intercept' AS term, round(regr_intercept(y, t), 2) AS estimate FROM x GROUP BY 1 UNION ALL SELECT series, 't', round(regr_slope(y, t), 4) FROM x GROUP BY 1",
)
def _(spark, d):
    x = orders_daily(spark, d).withColumn("t", F.date_diff(F.to_date("ts"), F.lit("1995-01-01").cast("date")).cast("double"))
    fit = linear_model.fit_many(x, {"Intercept": F.lit(1.0), "t": F.col("t")}, "y", K, alpha=0.0)
    return fit.withColumn("estimate", F.when(F.col("term") == "t", F.round("estimate", 4)).otherwise(F.round("estimate", 2)))


@query(
    "ols_line_items",
    "SELECT 'Intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS estimate, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4), round(regr_r2(l_extendedprice, l_quantity), 6) FROM lineitem",
)
def _(spark, d):
    made = regression.design(li := table(spark, d, "lineitem"), "l_extendedprice ~ l_quantity")
    g = regression.gram(li, made.columns, F.col("l_extendedprice"))
    rows, stats = regression.summary(g, regression.fit_ols(g))
    out = spark.createDataFrame([(r["term"], r["estimate"], stats["r2"]) for r in rows], "term string, estimate double, r2 double")
    return out.select("term", F.when(F.col("term") == "Intercept", F.round("estimate", 3)).otherwise(F.round("estimate", 4)).alias("estimate"), F.round("r2", 6).alias("r2"))


@query(
    "categorical_regression",
    "SELECT 'Intercept' AS term, round(avg(o_totalprice), 2) AS estimate FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'o_orderstatus[T.' || o_orderstatus || ']', round(avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F'), 2) FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus",
)
def _(spark, d):
    o = table(spark, d, "orders")
    made = regression.design(o, "o_totalprice ~ C(o_orderstatus)")
    fit = regression.fit_ols(regression.gram(o, made.columns, F.col("o_totalprice")))
    return spark.createDataFrame([(k, round(v, 2)) for k, v in fit.coefficients().items()], "term string, estimate double")


def orders_total(spark, d):
    """Value of all orders of a day, whatever their status; null on days without orders."""
    o = table(spark, d, "orders").select(F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("ts"), "o_totalprice")
    return timegrid.fill_gaps(o.groupBy("ts").agg(money("o_totalprice").alias("y")), "1 day").select("ts", "y")


@query("trend_changepoints")
def _(spark, d):
    found = changepoints.trend_changepoints(orders_total(spark, d), yearly_order=4)
    return spark.createDataFrame([(t,) for t in found], "ts timestamp_ntz")


@query("seasonality_orders")
def _(spark, d):
    df = orders_total(spark, d)
    rows = [(n, *[r[k] for k in ("order", "aic", "bic")]) for n in ("weekly", "yearly") for r in seasonality.order_criteria(df, seasonality.COMPONENTS[n], 4)]
    return spark.createDataFrame(rows, "component string, k int, aic double, bic double")


@query("forecast_linear")
def _(spark, d):
    """Trend, seasonality, holidays, autoregression beyond the horizon, ridge and intervals by weekday."""
    df = orders_total(spark, d)
    hol = events.event_keys(events.holidays(spark, ["US"], 1995, 2002), ["Christmas Day", "Thanksgiving"])
    spec = linear_model.ModelSpec(seasonality={"weekly": 3, "yearly": 5}, event_keys=["Christmas_Day", "Thanksgiving"], autoreg={"orders": [14, 15], "intervals": [(14, 20)]}, uncertainty={"by": ["dow"], "quantiles": (0.025, 0.975)})
    model = linear_model.fit_linear(df, spec, hol)
    return linear_model.predict_linear(model, linear_model.future_rows(spark, model, 14)).select("ts", "forecast", "forecast_lower", "forecast_upper")


@query("forecast_linear_simulated")
def _(spark, d):
    """Autoregression within the horizon: recursive paths."""
    spec = linear_model.ModelSpec(seasonality={"weekly": 3}, autoreg={"orders": [1, 2, 7], "intervals": [(1, 7)]}, uncertainty={"quantiles": (0.1, 0.9)})
    model = linear_model.fit_linear(orders_total(spark, d), spec)
    return linear_model.predict_linear(model, linear_model.future_rows(spark, model, 14), paths=20).select("ts", "forecast", "forecast_lower", "forecast_upper", "err_std")


@query("forecast_multistage", STAGES)
def _(spark, d):
    """A daily stage over the whole history, then hourly seasonality of what it leaves, per series."""
    g = timegrid.fill_gaps(events_hourly(spark, d), "1 hour", K)
    sp = cal.add_time_features(timegrid.train_test_split(g, 48, K), ["dow", "hour"])
    train, test = sp.filter("not is_test"), sp.filter("is_test")
    day = timegrid.bin_start(F.col("ts"), "D")
    coarse = cal.add_time_features(timegrid.resample(train, "D", {"y": F.avg("y")}, K), ["dow"])
    ask = cal.add_time_features(sp.select("series", day.alias("ts")).distinct(), ["dow"])
    stage1 = forecasters.similarity_forecast(coarse, ask, ["dow"], keys=K)
    fitted = train.withColumn("_d", day).join(stage1.select("series", F.col("ts").alias("_d"), "forecast"), ["series", "_d"]).withColumn("y", F.col("y") - F.col("forecast")).drop("forecast", "_d")
    stage2 = forecasters.similarity_forecast(fitted, test.select("series", "ts", "hour"), ["hour"], keys=K)
    return rounded(forecasters.combine_stages([stage1, stage2], test.select("series", "ts", F.col("y").alias("actual")), [day, F.col("ts")], K))


@query("benchmark_forecasters", BENCHMARK)
def _(spark, d):
    """Seasonal means by three keys over four rolling origins, errors by configuration."""
    from tidewater.functions import metrics as m

    g = cal.add_time_features(timegrid.fill_gaps(events_hourly(spark, d), "1 hour", K), ["dow_hr", "hour", "is_weekend"])
    rolled = evaluation.with_rolling_roles(g, 24, 24, 4, K)
    train, test = rolled.filter("role = 'train'").drop("role"), rolled.filter("role = 'test'").drop("role")
    out = None
    for name, match in {"dow_hr": ["dow_hr"], "hour": ["hour"], "hour_weekend": ["hour", "is_weekend"]}.items():
        f = forecasters.similarity_forecast(train, test, match, keys=["series", "back"]).withColumnRenamed("y", "actual").filter("actual is not null").withColumn("config", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return rounded(m.evaluate(out, ["config", "series"], ["MAE", "RMSE", "sMAPE"]))


# ---- reconciliation: revenue of nations and regions by month

_TREE = """base AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS ts, 'r' || n_regionkey AS region, 'n' || n_nationkey AS nation, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def _revenue(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    o = table(spark, d, "orders").select("o_custkey", F.date_trunc("MONTH", "o_orderdate").cast("timestamp_ntz").alias("ts"), "o_totalprice")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("ts", F.concat(F.lit("r"), "n_regionkey").alias("region"), F.concat(F.lit("n"), "n_nationkey").alias("nation"), "o_totalprice")


@query(
    "reconcile_bottom_up",
    f"WITH {_TREE}, l AS (SELECT ts, nation AS node, sum(v::DECIMAL(18,2))::DOUBLE AS value FROM base GROUP BY 1, 2) SELECT * FROM l UNION ALL SELECT ts, region, sum(v::DECIMAL(18,2))::DOUBLE FROM base GROUP BY 1, 2 UNION ALL SELECT ts, 'all', sum(v::DECIMAL(18,2))::DOUBLE FROM base GROUP BY 1",
)
def _(spark, d):
    rev = _revenue(spark, d)
    n = table(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").collect()  # the 25 nations
    regions = sorted({r.n_regionkey for r in n})
    h = reconcile.Hierarchy([[len(regions)], [sum(x.n_regionkey == r for x in n) for r in regions]])
    nodes = ["all", *[f"r{r}" for r in regions], *[f"n{x.n_nationkey}" for x in n]]
    leaves = rev.groupBy("ts", F.col("nation").alias("node")).agg(money("o_totalprice").alias("value"))
    return rounded(reconcile.fit_reconciler(h, nodes, "bottom_up").apply(leaves), 2)


@query(
    "reconcile_ols",
    f"""WITH {OD}, p AS (SELECT ts, coalesce(max(y) FILTER (WHERE series = 'F'), 0) AS f, coalesce(max(y) FILTER (WHERE series = 'O'), 0) AS o, coalesce(max(y) FILTER (WHERE series = 'P'), 0) AS p FROM od GROUP BY 1), b AS (SELECT *, (f + o + p) * 1.1371 AS t FROM p), g AS (SELECT *, (t - f - o - p) / 4 AS g FROM b)
    SELECT ts, 'F' AS node, round(f + g, 2) AS value FROM g UNION ALL SELECT ts, 'O', round(o + g, 2) FROM g UNION ALL SELECT ts, 'P', round(p + g, 2) FROM g UNION ALL SELECT ts, 'all', round(f + o + p + 3 * g, 2) FROM g""",
)
def _(spark, d):
    wide = orders_daily(spark, d).groupBy("ts").pivot("series", ["F", "O", "P"]).agg(F.max("y")).fillna(0.0)
    wide = wide.withColumn("all", (F.col("F") + F.col("O") + F.col("P")) * 1.1371)
    nodes = ["all", "F", "O", "P"]
    return rounded(reconcile.fit_reconciler(reconcile.Hierarchy([[3]]), nodes, "ols").apply(reconcile.wide_to_long(wide, nodes)), 2)


@query("reconcile_mint")
def _(spark, d):
    """Minimum trace over monthly revenue of regions, with the month before as forecast."""
    rev = _revenue(spark, d).groupBy("ts", F.col("region").alias("node")).agg(money("o_totalprice").alias("value"))
    total = rev.groupBy("ts").agg(F.sum("value").alias("value")).withColumn("node", F.lit("all"))
    actual = rev.unionByName(total)
    from pyspark.sql import Window

    forecast = actual.withColumn("value", F.lag("value").over(Window.partitionBy("node").orderBy("ts"))).filter("value is not null")
    nodes = ["all", *[f"r{k}" for k in range(5)]]
    r = reconcile.fit_reconciler(reconcile.Hierarchy([[5]]), nodes, "mint_sample", actual, forecast)
    return r.apply(forecast)
