"""Queries over fitted models, rewards, hierarchies and search results, held against closed forms in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import changepoints, detect, evaluation, labels, reconcile, regression, timegrid
from tidewater.queries._base import OD, OG, orders_daily, query, rounded, table
from tidewater.queries.detection import LAB, labelled
from tidewater.queries.further import _NODES, _nodes

K = ["series"]

#: Price on quantity, by return flag: one regressor, so that every statistic has a closed form.
_LINE = """x AS (SELECT l_returnflag AS flag, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS q FROM lineitem),
a AS (SELECT flag, count(*)::DOUBLE AS n, regr_slope(y, q) AS b, regr_intercept(y, q) AS a, regr_sxx(y, q) AS sxx, regr_sxy(y, q) AS sxy, regr_syy(y, q) AS syy, avg(q) AS mq, avg(y) AS my FROM x GROUP BY 1),
s AS (SELECT *, syy - b * sxy AS sse FROM a)"""


def _lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("q"))


def _grams(spark, d):
    """Sums of each flag; as many rows as flags reach the driver."""
    columns = {"Intercept": F.lit(1.0), "quantity": F.col("q")}
    return [(r.flag, regression.gram_from(r.sums, list(columns))) for r in regression.gram_table(_lines(spark, d), list(columns.values()), F.col("y"), None, ["flag"]).collect()]


@query(
    "coefficient_summary",
    f"""WITH {_LINE} SELECT flag, 'Intercept' AS term, round(a, 4) AS estimate, round(sqrt(sse / (n - 2) * (1 / n + mq * mq / sxx)), 4) AS std_err, round(a / sqrt(sse / (n - 2) * (1 / n + mq * mq / sxx)), 3) AS t FROM s
    UNION ALL SELECT flag, 'quantity', round(b, 4), round(sqrt(sse / (n - 2) / sxx), 4), round(b / sqrt(sse / (n - 2) / sxx), 3) FROM s""",
)
def _(spark, d):
    rows = [(flag, r["term"], r["estimate"], r["std_err"], r["t"]) for flag, g in _grams(spark, d) for r in regression.summary(g, regression.fit_ols(g))[0]]
    out = spark.createDataFrame(rows, "flag string, term string, estimate double, std_err double, t double")
    return out.select("flag", "term", F.round("estimate", 4).alias("estimate"), F.round("std_err", 4).alias("std_err"), F.round("t", 3).alias("t"))


@query(
    "fit_statistics",
    f"""WITH {_LINE}, l AS (SELECT *, -n / 2 * (ln(2 * pi() * sse / n) + 1) AS ll FROM s)
    SELECT flag, n::BIGINT AS n, round(1 - sse / syy, 8) AS r2, round(1 - sse / (n - 2) / (syy / (n - 1)), 8) AS r2_adjusted, round((syy - sse) / (sse / (n - 2)), 1) AS f, round(4 - 2 * ll, 2) AS aic, round(ln(n) * 2 - 2 * ll, 2) AS bic FROM l""",
)
def _(spark, d):
    names = ("r2", "r2_adjusted", "f", "aic", "bic")
    rows = []
    for flag, g in _grams(spark, d):
        stats = regression.summary(g, regression.fit_ols(g))[1]
        rows.append((flag, int(stats["n"]), *[stats[k] for k in names]))
    out = spark.createDataFrame(rows, "flag string, n long, " + ", ".join(f"{k} double" for k in names))
    digits = {"r2": 8, "r2_adjusted": 8, "f": 1, "aic": 2, "bic": 2}
    return out.select("flag", "n", *[F.round(k, v).alias(k) for k, v in digits.items()])


@query(
    "penalised_slopes",
    f"WITH {_LINE} SELECT flag, round(sxy / (sxx + 1e5), 6) AS ridge, round(greatest(sxy / n - 500, 0) / (sxx / n), 6) AS lasso, round(b, 6) AS free FROM s",
)
def _(spark, d):
    rows = []
    for flag, g in _grams(spark, d):
        fits = [regression.fit_partial(g, l2=["quantity"], l2_alpha=1e5), regression.fit_partial(g, l1=["quantity"], l1_alpha=500.0), regression.fit_partial(g)]
        rows.append((flag, *[float(f.coefficients()["quantity"]) for f in fits]))
    return rounded(spark.createDataFrame(rows, "flag string, ridge double, lasso double, free double"), 6)


@query(
    "prediction_breakdown",
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS q FROM lineitem), f AS (SELECT regr_slope(y, q) AS b, avg(q) AS mq, avg(y) AS my FROM x) SELECT l_orderkey, l_linenumber, round(my, 4) AS base, round(b * (q - mq), 4) AS quantity, 0.0::DOUBLE AS other, round(my + b * (q - mq), 4) AS forecast FROM x CROSS JOIN f",
)
def _(spark, d):
    li = _lines(spark, d)
    columns = {"Intercept": F.lit(1.0), "quantity": F.col("q")}
    fit = regression.fit_ols(regression.gram(li, columns, F.col("y")))
    parts = regression.breakdown(regression.predict(li, columns, fit, "forecast"), columns, fit, {"quantity": "quantity"}, centre=True)
    return parts.select("l_orderkey", "l_linenumber", F.round("Intercept", 4).alias("base"), F.round("quantity", 4).alias("quantity"), F.col("OTHER").cast("double").alias("other"), F.round("forecast", 4).alias("forecast"))


_GRID = [10.0, 25.0, 50.0, 75.0]


@query(
    "anomaly_rewards",
    f"""WITH {LAB}, th AS (SELECT unnest({_GRID}) AS threshold), x AS (SELECT series, threshold::DOUBLE AS threshold, is_anomaly AS t, coalesce(100 * abs(actual - forecast) / nullif(abs(actual), 0) > threshold, FALSE) AS p FROM lab CROSS JOIN th),
    c AS (SELECT series, threshold, 100 * avg(p::INTEGER) AS share, count(*) FILTER (t AND p) AS hits, count(*) FILTER (p) AS np, count(*) FILTER (t) AS nt FROM x GROUP BY 1, 2)
    SELECT series, threshold, round(-abs(share - 15) / 100, 6) AS near_share, round(CASE WHEN np + nt > 0 THEN 2 * hits / (np + nt) ELSE 0 END + CASE WHEN share < 20 * (1 - 0.5) OR share > 20 * (1 + 0.5) THEN -1 ELSE 0 END + CASE WHEN CASE WHEN np > 0 THEN hits / np ELSE 0 END < 0.3 THEN -1 ELSE 0 END, 6) AS floors FROM c""",
)
def _(spark, d):
    rows = labelled(spark, d).withColumn("ape", detect.ape([F.col("actual")], [F.col("forecast")]))
    grid, out = detect.param_grid(spark, {"threshold": _GRID}), None
    for name, reward in {"near_share": detect.percent_reward(10, 20), "floors": detect.config_reward("F1", 20, 0.5, min_precision=0.3)}.items():
        one = detect.score_grid(rows, grid, F.col("ape") > F.col("threshold"), reward, keys=K).select("series", "threshold", F.round("reward", 6).alias(name))
        out = one if out is None else out.join(one, ["series", "threshold"])
    return out


@query(
    "merge_anomaly_sources",
    f"""WITH {OG}, m AS (SELECT *, avg(y) OVER (PARTITION BY series) AS m FROM og), h AS (SELECT series, ts FROM m WHERE y > 1.2 * m OR (isodow(ts) = 7 AND y > m)),
    i AS (SELECT *, ts - to_days(row_number() OVER (PARTITION BY series ORDER BY ts)::INTEGER) AS g FROM h) SELECT series, min(ts) AS start_time, max(ts) AS end_time FROM i GROUP BY series, g""",
)
def _(spark, d):
    from pyspark.sql.window import Window

    day = timegrid.fill_gaps(orders_daily(spark, d), "1 day", K).withColumn("m", F.avg("y").over(Window.partitionBy("series")))
    high = day.withColumn("hit", F.coalesce(F.col("y") > 1.2 * F.col("m"), F.lit(False)))
    sunday = day.withColumn("hit", F.coalesce((F.weekday("ts") == 6) & (F.col("y") > F.col("m")), F.lit(False)))
    return detect.merge_anomaly_sources([labels.label_to_intervals(s, "hit", K) for s in (high, sunday)], "1 day", K)


@query(
    "step_regressors",
    f"WITH {OD} SELECT series, ts, y, (ts >= TIMESTAMP '1995-07-02')::INTEGER AS ctp_1995_07_02_00, (ts >= TIMESTAMP '1997-01-01 12:00:00')::INTEGER AS ctp_1997_01_01_12 FROM od",
)
def _(spark, d):
    day = dt.datetime
    return changepoints.step_regressors(orders_daily(spark, d), [(day(1995, 7, 1), day(1995, 7, 3)), (day(1997, 1, 1), day(1997, 1, 2))])


@query(
    "hierarchy_violation",
    f"WITH {_NODES}, l AS (SELECT ts, sum(v::DECIMAL(18,2))::DOUBLE AS s FROM a WHERE node <> 'all' GROUP BY 1) SELECT ts, round(abs(a.v * 1.1 - l.s), 3) AS violation FROM a JOIN l USING (ts) WHERE node = 'all'",
)
def _(spark, d):
    off = _nodes(spark, d).withColumn("value", F.col("value") * F.when(F.col("node") == "all", 1.1).otherwise(1.0))
    return rounded(reconcile.violation(off, reconcile.Hierarchy([[5]]), ["all", *[f"r{k}" for k in range(5)]]), 3)


@query(
    "search_summary",
    "WITH c AS (SELECT l_linenumber AS config, l_returnflag || l_linestatus AS split, round(avg(l_discount::DOUBLE), 8) AS score FROM lineitem GROUP BY 1, 2) SELECT config, round(avg(score), 7) AS mean_score, round(stddev_pop(score), 7) AS std_score, string_agg(printf('%.8f', score), ' ' ORDER BY split) AS splits FROM c GROUP BY 1",
)
def _(spark, d):
    cv = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("config"), F.concat("l_returnflag", "l_linestatus").alias("split")).agg(F.round(F.avg(F.col("l_discount").cast("double")), 8).alias("score"))
    out = evaluation.summarise_search(cv, ["score"], ["config"])
    return out.select("config", F.round("mean_score", 7).alias("mean_score"), F.round("std_score", 7).alias("std_score"), F.array_join(F.transform("splits_score", lambda x: F.format_string("%.8f", x)), " ").alias("splits"))
