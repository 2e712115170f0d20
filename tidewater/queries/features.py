"""Queries of sources, grids, calendar features, lags, cleaning and events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import calendar as cal
from tidewater.operators import clean, lags, timegrid
from tidewater.queries._base import EG, EH, OD, OG, events_hourly, money, orders_daily, query, rounded, table

STEP = "1 day"


def daily_grid(spark: SparkSession, d: str) -> DataFrame:
    return timegrid.fill_gaps(orders_daily(spark, d), STEP, ["series"])


# ---- resampling


@query("scan_series_daily_orders", f"WITH {OD} SELECT * FROM od")
def _(spark, d):
    return orders_daily(spark, d)


@query("resample_hourly_events", f"WITH {EH} SELECT * FROM eh")
def _(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "series")
    return timegrid.resample(e, "H", {"y": money("value", 4)}, ["series"])


def _resample_orders(spark, d, freq):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("series"), F.col("o_orderdate").alias("ts"), "o_totalprice")
    return timegrid.resample(o, freq, {"y": money("o_totalprice"), "n": F.count("*")}, ["series"])


_BIN_SQL = "SELECT o_orderstatus AS series, {}::TIMESTAMP AS ts, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y, count(*) AS n FROM orders GROUP BY 1, 2"


@query("resample_weekly_mon_orders", _BIN_SQL.format("(o_orderdate::DATE + ((8 - isodow(o_orderdate)) % 7)::INTEGER)"))
def _(spark, d):
    return _resample_orders(spark, d, "W-MON")


@query("resample_monthly_orders", _BIN_SQL.format("date_trunc('month', o_orderdate)"))
def _(spark, d):
    return _resample_orders(spark, d, "MS")


@query(
    "resample_7d_orders",
    "WITH f AS (SELECT o_orderstatus AS s, min(o_orderdate)::DATE AS d0 FROM orders GROUP BY 1) "
    "SELECT o_orderstatus AS series, (d0 + (((o_orderdate::DATE - d0) // 7) * 7)::INTEGER)::TIMESTAMP AS ts, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y, count(*) AS n FROM orders JOIN f ON s = o_orderstatus GROUP BY 1, 2",
)
def _(spark, d):
    return _resample_orders(spark, d, "7D")


@query(
    "drop_incomplete_bins",
    "WITH b AS (SELECT event_type AS series, ts, date_trunc('day', ts) AS bin FROM events), n AS (SELECT series, bin, count(*) AS n, min(bin) OVER (PARTITION BY series) AS lo, max(bin) OVER (PARTITION BY series) AS hi FROM b GROUP BY 1, 2) "
    "SELECT b.series, b.bin::DATE AS day, count(*) AS n FROM b JOIN n USING (series, bin) WHERE NOT ((bin = lo OR bin = hi) AND n.n < 200) GROUP BY 1, 2",
)
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("series"), "ts")
    return timegrid.drop_incomplete_bins(e, "D", 200, ["series"]).groupBy("series", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("scan_lineitem_daily", "SELECT l_returnflag AS series, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, round(sum((l_extendedprice * l_quantity)::DECIMAL(28,4)) / sum(l_quantity)::DECIMAL(18,2)::DOUBLE, 1) AS weighted, median(l_extendedprice) AS med, max(l_discount) AS top FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("series"), F.col("l_shipdate").alias("ts"), "l_extendedprice", "l_quantity", "l_discount")
    weighted = F.round(F.sum((F.col("l_extendedprice") * F.col("l_quantity")).cast("decimal(28,4)")).cast("double") / F.sum("l_quantity").cast("decimal(18,2)").cast("double"), 1)
    return timegrid.resample(li, "D", {"weighted": weighted, "med": F.median("l_extendedprice"), "top": F.max("l_discount")}, ["series"])


# ---- grids


@query("gap_fill_hourly", f"WITH {EG} SELECT * FROM eg")
def _(spark, d):
    return timegrid.fill_gaps(events_hourly(spark, d), "1 hour", ["series"])


@query("gap_fill_daily", f"WITH {OG} SELECT * FROM og")
def _(spark, d):
    return daily_grid(spark, d)


@query("gap_fill_counts", f"WITH {OG} SELECT og.series, count(*) FILTER (WHERE od.ts IS NULL) AS added, 0::BIGINT AS dropped FROM og LEFT JOIN od USING (series, ts) GROUP BY 1")
def _(spark, d):
    return timegrid.fill_gap_counts(orders_daily(spark, d), STEP, ["series"])


@query(
    "find_gaps",
    f"WITH {OD}, g AS (SELECT series, ts AS before, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS after FROM od), h AS (SELECT *, date_diff('second', before, after) AS s FROM g), m AS (SELECT *, min(s) OVER (PARTITION BY series) AS m FROM h) "
    "SELECT series, before, after, s::DOUBLE / m - 1 AS gap_size FROM m WHERE s > m",
)
def _(spark, d):
    return timegrid.find_gaps(orders_daily(spark, d), ["series"])


@query("min_gap", f"WITH {EH}, g AS (SELECT series, date_diff('second', lag(ts) OVER (PARTITION BY series ORDER BY ts), ts)::DOUBLE AS s FROM eh) SELECT series, min(s) AS min_gap FROM g GROUP BY 1")
def _(spark, d):
    return timegrid.min_gap_seconds(events_hourly(spark, d), ["series"])


@query(
    "time_stats",
    f"WITH {OD}, g AS (SELECT series, ts, date_diff('second', lag(ts) OVER (PARTITION BY series ORDER BY ts), ts)::DOUBLE AS s FROM od) "
    "SELECT series, count(*) AS data_points, min(ts) AS min_timestamp, max(ts) AS max_timestamp, round(avg(s), 6) AS mean_delta, median(s) AS median_delta, min(s) AS min_delta, max(s) AS max_delta, min(s) = max(s) AS regular_increments FROM g GROUP BY 1",
)
def _(spark, d):
    return rounded(timegrid.time_stats(orders_daily(spark, d), ["series"]))


@query("history_days", f"WITH {OD}, g AS (SELECT series, ts, date_diff('second', lag(ts) OVER (PARTITION BY series ORDER BY ts), ts)::DOUBLE AS s FROM od) SELECT series, (date_diff('second', min(ts), max(ts)) + median(s)) / 86400 AS num_training_days, median(s) AS period, count(*) AS data_points FROM g GROUP BY 1")
def _(spark, d):
    return timegrid.history_days(orders_daily(spark, d), ["series"])


@query("dedupe_keep_first", "SELECT event_type, ts, event_id FROM (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def _(spark, d):
    e = table(spark, d, "events").select("event_type", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts"), "event_id")
    return timegrid.dedupe_keep_first(e, ["event_id"], ["event_type"])


@query("train_test_split", f"WITH {OD} SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 30 AS is_test FROM od")
def _(spark, d):
    return timegrid.train_test_split(orders_daily(spark, d), 30, ["series"])


@query("future_frame", f"WITH {OD}, m AS (SELECT series, max(ts) AS t FROM od GROUP BY 1) SELECT series, unnest(generate_series(t + INTERVAL 1 DAY, t + INTERVAL 14 DAY, INTERVAL 1 DAY)) AS ts FROM m")
def _(spark, d):
    return timegrid.future_frame(orders_daily(spark, d), STEP, 14, ["series"])


@query("aggregate_from_end", f"WITH {OD}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) - 1 AS r, count(*) OVER (PARTITION BY series) AS n FROM od) SELECT series, min(ts) AS ts, sum(y::DECIMAL(18,2))::DOUBLE AS y FROM r WHERE r // 7 < n // 7 OR n < 7 GROUP BY series, r // 7")
def _(spark, d):
    return rounded(timegrid.aggregate_from_end(orders_daily(spark, d), 7, "sum", ["series"]), 2)


@query("value_summary", f"WITH {OD} SELECT series, count(y) AS count, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std, min(y) AS min, round(quantile_cont(y, 0.25), 4) AS q25, round(quantile_cont(y, 0.5), 4) AS q50, round(quantile_cont(y, 0.75), 4) AS q75, max(y) AS max FROM od GROUP BY 1")
def _(spark, d):
    return rounded(clean.summarise(orders_daily(spark, d), keys=["series"]), 4)


# ---- calendar features

_T = "SELECT DISTINCT o_orderdate AS ts FROM orders"


def _times(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderdate").alias("ts")).distinct()


_LEAP = "(CASE WHEN dayofyear(make_date(year(ts), 12, 31)) = 366 THEN 1 ELSE 0 END)"
_TOD = "(hour(ts) + minute(ts) / 60.0::DOUBLE + second(ts) / 3600.0::DOUBLE)"


@query(
    "time_features_orders",
    f"""WITH t AS ({_T}), x AS (SELECT ts, {_LEAP} AS leap, {_TOD} AS tod, dayofyear(ts) AS doy, isodow(ts) AS dow, date_trunc('quarter', ts)::DATE AS qs FROM t)
    SELECT ts, year(ts)::INTEGER AS year, CASE WHEN leap = 1 THEN 366.0::DOUBLE ELSE 365.0::DOUBLE END AS year_length, quarter(ts)::INTEGER AS quarter, qs AS quarter_start, ((qs + INTERVAL 3 MONTH)::DATE - qs)::INTEGER AS quarter_length,
      month(ts)::INTEGER AS month, day(last_day(ts))::INTEGER AS month_length, doy::INTEGER AS doy, (ts::DATE - qs + 1)::INTEGER AS doq, day(ts)::INTEGER AS dom, dow::INTEGER AS dow, dow || '-' || strftime(ts, '%a') AS str_dow,
      strftime(ts, '%Y-%m-%d') AS str_doy, year(ts) || '-' || quarter(ts) AS year_quarter, strftime(ts, '%Y-%m') AS year_month, strftime(ts, '%m/%d') AS month_dom,
      round(tod, 8) AS tod, round(dow - 1 + tod / 24, 8) AS tow, round((day(ts) - 1 + tod / 24) / day(last_day(ts)), 8) AS tom, round((ts::DATE - qs + tod / 24) / ((qs + INTERVAL 3 MONTH)::DATE - qs), 8) AS toq,
      round((doy - 1 - (CASE WHEN leap = 1 AND doy > 60 THEN 1 ELSE 0 END) + tod / 24 * (CASE WHEN leap = 1 AND doy = 60 THEN 0 ELSE 1 END)) / 365.0::DOUBLE, 8) AS toy, dow IN (6, 7) AS is_weekend,
      CASE WHEN dow <= 4 THEN '1234-MTuWTh' ELSE dow || '-' || strftime(ts, '%a') END AS dow_grouped FROM x""",
)
def _(spark, d):
    names = ["year", "year_length", "quarter", "quarter_start", "quarter_length", "month", "month_length", "doy", "doq", "dom", "dow", "str_dow", "str_doy", "year_quarter", "year_month", "month_dom", "tod", "tow", "tom", "toq", "toy", "is_weekend", "dow_grouped"]
    return rounded(cal.add_time_features(_times(spark, d), names), 8)


@query(
    "iso_features",
    f"""WITH t AS ({_T}), x AS (SELECT ts, lpad(weekofyear(ts)::VARCHAR, 2, '0') AS w, isodow(ts)::VARCHAR AS dow FROM t)
    SELECT ts, weekofyear(ts)::INTEGER AS woy, year(ts) || '_' || w AS year_woy, year(ts) || '_' || w || '_' || dow AS year_woy_dow, strftime(ts, '%W') || '_' || dow AS woy_dow, isoyear(ts)::INTEGER AS year_iso, isoyear(ts) || '_' || w AS year_woy_iso, isoyear(ts) || '_' || w || '_' || dow AS year_woy_dow_iso,
      dow || '_' || strftime(ts, '%H') AS dow_hr, dow || '_' || strftime(ts, '%H') || '_' || strftime(ts, '%M') AS dow_hr_min FROM x""",
)
def _(spark, d):
    return cal.add_time_features(_times(spark, d), ["woy", "year_woy", "year_woy_dow", "woy_dow", "year_iso", "year_woy_iso", "year_woy_dow_iso", "dow_hr", "dow_hr_min"])


_CT = f"(year(ts) + (dayofyear(ts) - 1 + {_TOD} / 24) / (365.0::DOUBLE + {_LEAP}))"


@query(
    "continuous_time",
    f"WITH t AS ({_T}), x AS (SELECT ts, {_CT} AS c FROM t) SELECT ts, round(c, 6) AS conti_year, round(c - 1998, 6) AS ct1, round(sign(c - 1998) * (c - 1998) ** 2, 6) AS ct2, round(sign(c - 1998) * abs(c - 1998) ** 3, 6) AS ct3, round(sign(c - 1998) * sqrt(abs(c - 1998)), 6) AS ct_sqrt, round(sign(c - 1998) * abs(c - 1998) ** (1.0::DOUBLE / 3), 6) AS ct_root3 FROM x",
)
def _(spark, d):
    return rounded(cal.add_time_features(_times(spark, d), ["conti_year", "ct1", "ct2", "ct3", "ct_sqrt", "ct_root3"], origin=1998.0), 6)


def _sunday(month: int, nth: int) -> str:
    if nth > 0:
        first = f"make_date(year(ts), {month}, 1)"
        return f"({first} + ((7 - isodow({first})) % 7 + {7 * (nth - 1)})::INTEGER)"
    last = f"last_day(make_date(year(ts), {month}, 1))"
    return f"({last} - (isodow({last}) % 7)::INTEGER)"


@query(
    "dst_flags",
    f"""WITH t AS (SELECT DISTINCT ts + to_years(h::INTEGER) AS ts FROM (SELECT date_trunc('hour', o_orderdate) AS ts FROM orders) CROSS JOIN (SELECT unnest([0, 10, 20]) AS h))
    SELECT ts, year(ts) BETWEEN 2007 AND 2079 AND ts BETWEEN {_sunday(3, 2)} + INTERVAL 2 HOUR AND {_sunday(11, 1)} + INTERVAL 2 HOUR AS us_dst,
      year(ts) BETWEEN 1996 AND 2079 AND ts BETWEEN {_sunday(3, -1)} + INTERVAL 1 HOUR AND {_sunday(10, -1)} + INTERVAL 1 HOUR AS eu_dst FROM t""",
)
def _(spark, d):
    t = table(spark, d, "orders").select(F.date_trunc("HOUR", "o_orderdate").cast("timestamp_ntz").alias("ts"), F.explode(F.array(*[F.lit(k) for k in (0, 10, 20)])).alias("h"))
    t = t.select((F.col("ts") + F.make_ym_interval(F.col("h"))).alias("ts")).distinct()
    return cal.add_time_features(t, ["us_dst", "eu_dst"])


def _fourier_sql(expr: str, col: str, period: float, order: int, name: str) -> str:
    return ", ".join(f"round({f}({expr} * {2 * math.pi * k / period!r}::DOUBLE), 6) AS {f}{k}_{col}_{name}" for k in range(1, order + 1) for f in ("sin", "cos"))


@query("fourier_daily", f"WITH {EH}, x AS (SELECT series, ts, {_TOD} AS tod FROM eh) SELECT series, ts, {_fourier_sql('tod', 'tod', 24, 4, 'daily')} FROM x")
def _(spark, d):
    e = cal.add_time_features(events_hourly(spark, d), ["tod"])
    return rounded(e.select("series", "ts", *[c.alias(k) for k, c in cal.fourier_terms("tod", 24, 4, "daily").items()]))


@query(
    "fourier_multi",
    f"WITH t AS ({_T}), x AS (SELECT ts, isodow(ts) - 1 + {_TOD} / 24 AS tow, {_CT} - 1995 AS ct1 FROM t) SELECT ts, {_fourier_sql('tow', 'tow', 7, 3, 'weekly')}, {_fourier_sql('ct1', 'ct1', 1, 5, 'yearly')} FROM x",
)
def _(spark, d):
    t = cal.add_time_features(_times(spark, d), ["tow", "ct1"], origin=1995.0)
    terms = cal.fourier_multi(["tow", "ct1"], [7.0, 1.0], [3, 5], ["weekly", "yearly"])
    return rounded(t.select("ts", *[c.alias(k) for k, c in terms.items()]))


@query("changepoint_hinges", f"WITH t AS ({_T}), x AS (SELECT ts, {_CT} - 1995 AS c FROM t) SELECT ts, round(greatest(c - 1.5, 0), 8) AS changepoint0, round(greatest(c - 3.25, 0), 8) AS changepoint1, round(CASE WHEN c >= 2 THEN sqrt(c - 2) ELSE 0 END, 8) AS root0 FROM x")
def _(spark, d):
    t = cal.add_time_features(_times(spark, d), ["ct1"], origin=1995.0)
    terms = cal.changepoint_terms([1.5, 3.25], F.col("ct1")) | cal.changepoint_terms([2.0], F.col("ct1"), F.sqrt, ["root0"])
    return rounded(t.select("ts", *[c.alias(k) for k, c in terms.items()]), 8)


@query("growth_terms", f"WITH t AS ({_T}), x AS (SELECT ts, {_CT} - 1998 AS c FROM t) SELECT ts, round(1 + 10 / (1 + exp(-2 * (c - 0.5))), 8) AS logistic, round(sign(c) * abs(c) ** 1.5, 8) AS power FROM x")
def _(spark, d):
    t = cal.add_time_features(_times(spark, d), ["ct1"], origin=1998.0)
    return rounded(t.select("ts", cal.logistic(F.col("ct1"), 2.0, 10.0, 1.0, 0.5).alias("logistic"), cal.signed_power(F.col("ct1"), 1.5).alias("power")), 8)


@query(
    "evenly_spaced_changepoints",
    f"WITH {OD}, r AS (SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM od), k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k) SELECT series, k::INTEGER AS k, ts FROM r JOIN k ON i = floor(k * n / 6.0)",
)
def _(spark, d):
    from tidewater.operators.changepoints import evenly_spaced_times

    return evenly_spaced_times(orders_daily(spark, d), 5, ["series"])


# ---- lags


@query("lag_1_2_7", f"WITH {OG} SELECT series, ts, lag(y, 1) OVER w AS y_lag1, lag(y, 2) OVER w AS y_lag2, lag(y, 7) OVER w AS y_lag7 FROM og WINDOW w AS (PARTITION BY series ORDER BY ts)")
def _(spark, d):
    g = daily_grid(spark, d)
    return g.select("series", "ts", *[c.alias(k) for k, c in lags.lag_columns("y", [1, 2, 7], ["series"]).items()])


@query(
    "agg_lag_sets",
    f"WITH {OG}, l AS (SELECT series, ts, [x for x in [lag(y, 7) OVER w, lag(y, 14) OVER w, lag(y, 21) OVER w] if x IS NOT NULL] AS a FROM og WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT series, ts, round(list_avg(a), 4) AS y_avglag_7_14_21, list_min(a) AS y_minimumlag_7_14_21, round(list_median(a), 4) AS y_medianlag_7_14_21 FROM l",
)
def _(spark, d):
    g = daily_grid(spark, d)
    exprs = {k: c for agg in ("mean", "minimum", "median") for k, c in lags.aggregated_lag_columns("y", [[7, 14, 21]], agg=agg, keys=["series"]).items()}
    return rounded(g.select("series", "ts", *[c.alias(k) for k, c in exprs.items()]), 4)


@query("agg_lag_intervals", f"WITH {OG} SELECT series, ts, round(avg(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS y_avglag_1_to_7, max(y) OVER (w ROWS BETWEEN 14 PRECEDING AND 8 PRECEDING) AS y_maximumlag_8_to_14 FROM og WINDOW w AS (PARTITION BY series ORDER BY ts)")
def _(spark, d):
    g = daily_grid(spark, d)
    exprs = lags.aggregated_lag_columns("y", intervals=[(1, 7)], keys=["series"]) | lags.aggregated_lag_columns("y", intervals=[(8, 14)], agg="maximum", keys=["series"])
    return rounded(g.select("series", "ts", *[c.alias(k) for k, c in exprs.items()]), 4)


@query(
    "autoreg_filled_lags",
    f"WITH {OG}, f AS (SELECT series, ts, y, coalesce(first_value(y IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(y IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v FROM og WINDOW w AS (PARTITION BY series ORDER BY ts)) "
    "SELECT series, ts, y, lag(v, 1) OVER w AS y_lag1, round(avg(v) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS y_avglag_1_to_7 FROM f WINDOW w AS (PARTITION BY series ORDER BY ts)",
)
def _(spark, d):
    return rounded(lags.add_lags(daily_grid(spark, d), orders=[1], intervals=[(1, 7)], keys=["series"]), 4)


@query("ffill_bfill", f"WITH {OG} SELECT series, ts, coalesce(last_value(y IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(y IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM og WINDOW w AS (PARTITION BY series ORDER BY ts)")
def _(spark, d):
    return daily_grid(spark, d).select("series", "ts", lags.fill_both_ways("y", ["series"], forward_first=True).alias("y"))


# ---- cleaning


@query(
    "interpolate_linear",
    f"""WITH {EG}, i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM eg),
    n AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(y IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni, first_value(y IGNORE NULLS) OVER a AS nv FROM i
      WINDOW b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT series, ts, round(coalesce(y, pv + (nv - pv) * (i - pi) / (ni - pi)::DOUBLE, pv, nv), 4) AS y FROM n""",
)
def _(spark, d):
    return rounded(clean.interpolate(timegrid.fill_gaps(events_hourly(spark, d), "1 hour", ["series"]), keys=["series"]), 4)


_IMPUTE_STEP = "SELECT series, ts, coalesce(y, list_avg([x for x in [lag(y, 7) OVER w, lag(y, 14) OVER w, lag(y, 21) OVER w] if x IS NOT NULL])) AS y FROM {} WINDOW w AS (PARTITION BY series ORDER BY ts)"


@query("impute_lags", f"WITH {OG}, a AS ({_IMPUTE_STEP.format('og')}), b AS ({_IMPUTE_STEP.format('a')}) SELECT series, ts, round(y, 4) AS y FROM b")
def _(spark, d):
    return rounded(clean.impute_with_lags(daily_grid(spark, d), iterations=2, keys=["series"]), 4)


@query(
    "outlier_zscore",
    f"""WITH {OD}, q AS (SELECT *, quantile_cont(y, 0.005) OVER (PARTITION BY series) AS a, quantile_cont(y, 0.995) OVER (PARTITION BY series) AS b FROM od), s AS (SELECT series, avg(y) AS m, stddev_pop(y) AS sd FROM q WHERE y BETWEEN a AND b GROUP BY 1)
    SELECT series, ts, y, round((y - m) / sd, 4) AS score, abs((y - m) / sd) > 3 AS is_outlier FROM od JOIN s USING (series)""",
)
def _(spark, d):
    return rounded(clean.zscore_outliers(orders_daily(spark, d), cutoff=3.0, keys=["series"]), 4)


@query(
    "outlier_tukey",
    f"""WITH {OD}, q AS (SELECT *, quantile_cont(y, 0.005) OVER (PARTITION BY series) AS a, quantile_cont(y, 0.995) OVER (PARTITION BY series) AS b FROM od), s AS (SELECT series, quantile_cont(y, 0.1) AS q0, quantile_cont(y, 0.9) AS q1 FROM q WHERE y BETWEEN a AND b GROUP BY 1),
    x AS (SELECT series, ts, y, CASE WHEN y > q1 THEN (y - q1) / (q1 - q0) WHEN y < q0 THEN (y - q0) / (q1 - q0) ELSE 0.0 END AS score FROM od JOIN s USING (series)) SELECT series, ts, y, round(score, 4) AS score, abs(score) > 0.5 AS is_outlier FROM x""",
)
def _(spark, d):
    return rounded(clean.tukey_outliers(orders_daily(spark, d), cutoff=0.5, keys=["series"]), 4)


@query(
    "moving_median_baseline",
    f"WITH {OD} SELECT series, ts, round(y - median(y) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS diff FROM od",
)
def _(spark, d):
    return rounded(clean.baseline_difference(orders_daily(spark, d), "moving_med", keys=["series"]).select("series", "ts", F.col("_diff").alias("diff")), 4)


@query("mask_outliers", f"WITH {OD} SELECT series, ts, CASE WHEN abs(y - avg(y) OVER w) / stddev_samp(y) OVER w > 2.5 THEN NULL ELSE y END AS y FROM od WINDOW w AS (PARTITION BY series)")
def _(spark, d):
    return clean.mask_outliers(orders_daily(spark, d), 2.5, keys=["series"])


@query("exponential_baseline", f"WITH {OD}, r AS (SELECT series, ts, y, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM od) SELECT a.series, a.ts, round(sum(b.y * 0.3 ** (a.i - b.i)) / sum(0.3 ** (a.i - b.i)), 2) AS ewm FROM r a JOIN r b ON a.series = b.series AND b.i BETWEEN a.i - 60 AND a.i GROUP BY 1, 2")
def _(spark, d):
    return clean.exponential_mean(orders_daily(spark, d), 0.7, keys=["series"]).select("series", "ts", F.round("ewm", 2).alias("ewm"))


_NORM = {
    "statistical": "(y - avg(y) OVER w) / stddev_samp(y) OVER w",
    "zero_to_one": "(y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w)",
    "minus_half_to_half": "(y - (min(y) OVER w + (max(y) OVER w - min(y) OVER w) / 2)) / (max(y) OVER w - min(y) OVER w)",
    "zero_at_origin": "(y - first_value(y) OVER (PARTITION BY series ORDER BY ts)) / (max(y) OVER w - min(y) OVER w)",
}
for _how, _expr in _NORM.items():

    @query(f"normalize_{_how}", f"WITH {OD} SELECT series, ts, round({_expr}, 6) AS y FROM od WINDOW w AS (PARTITION BY series)")
    def _(spark, d, how=_how):
        return rounded(clean.normalise(orders_daily(spark, d), ["y"], how, ["series"]))


@query(
    "adjust_anomalies",
    f"""WITH {OD}, a AS (SELECT series, min(ts) + to_days((k * 40)::INTEGER) AS s, min(ts) + to_days((k * 40 + k)::INTEGER) AS e, CASE WHEN k % 3 = 0 THEN NULL ELSE k * 100.0::DOUBLE END AS delta FROM od CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k) GROUP BY series, k),
    h AS (SELECT od.series, od.ts, sum(delta) AS delta, bool_or(delta IS NULL) AS void FROM od JOIN a ON od.series = a.series AND od.ts BETWEEN s AND e GROUP BY 1, 2)
    SELECT series, ts, round(CASE WHEN void IS NULL THEN y WHEN void THEN NULL ELSE y + delta END, 2) AS y, void IS NOT NULL AS touched FROM od LEFT JOIN h USING (series, ts)""",
)
def _(spark, d):
    o = orders_daily(spark, d)
    first = o.groupBy("series").agg(F.min("ts").alias("t")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(1, 7)])))
    days = lambda n: F.make_dt_interval(n)
    a = first.select("series", (F.col("t") + days(F.col("k") * 40)).alias("start_time"), (F.col("t") + days(F.col("k") * 41)).alias("end_time"), F.when(F.col("k") % 3 != 0, F.col("k") * 100.0).alias("adjustment_delta"))
    return rounded(clean.adjust_intervals(o, a, ["y"], keys=["series"], label="touched"), 2)


@query(
    "label_anomalies_multi_metric",
    f"""WITH {OD}, w AS (SELECT ts, sum(y::DECIMAL(18,2))::DOUBLE AS total, count(*)::DOUBLE AS statuses FROM od GROUP BY 1),
    a AS (SELECT metric, min(ts) + to_days(k * 30) AS s, min(ts) + to_days(k * 30 + 3) AS e FROM w CROSS JOIN (SELECT unnest(['total', 'statuses']) AS metric, unnest([1, 2]) AS k) GROUP BY metric, k)
    SELECT ts, total, statuses, EXISTS (SELECT 1 FROM a WHERE metric = 'total' AND w.ts BETWEEN s AND e) AS total_is_anomaly, EXISTS (SELECT 1 FROM a WHERE metric = 'statuses' AND w.ts BETWEEN s AND e) AS statuses_is_anomaly FROM w""",
)
def _(spark, d):
    w = orders_daily(spark, d).groupBy("ts").agg(money("y").alias("total"), F.count("*").cast("double").alias("statuses"))
    first = w.agg(F.min("ts").alias("t"))
    a = first.select(F.explode(F.array(F.struct(F.lit("total").alias("metric"), F.lit(1).alias("k")), F.struct(F.lit("statuses").alias("metric"), F.lit(2).alias("k")))).alias("x"), "t")
    a = a.select("x.metric", (F.col("t") + F.make_dt_interval(F.col("x.k") * 30)).alias("start_time"), (F.col("t") + F.make_dt_interval(F.col("x.k") * 30 + 3)).alias("end_time"))
    return clean.label_intervals(w, a, ["total", "statuses"])


@query("drop_degenerate", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").withColumns({"zero": F.lit(0.0), "same": F.lit("x")})
    return clean.drop_degenerate(li, li.columns)


@query(
    "lagged_baseline_score",
    f"""WITH {OD}, b AS (SELECT *, list_avg([x for x in [lead(y, 7) OVER w, lag(y, 7) OVER w] if x IS NOT NULL]) AS base FROM od WINDOW w AS (PARTITION BY series ORDER BY ts)), r AS (SELECT *, y - base AS raw FROM b)
    SELECT series, ts, round((raw - avg(raw) OVER w) / stddev_pop(raw) OVER w, 4) AS score FROM r WINDOW w AS (PARTITION BY series)""",
)
def _(spark, d):
    return rounded(clean.lagged_baseline_outliers(orders_daily(spark, d), [7, -7], keys=["series"]).select("series", "ts", "score"), 4)
