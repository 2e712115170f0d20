"""Queries over operators that no other query applies by itself."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import calendar as cal
from tidewater.operators import clean, detect, evaluation, events, labels, lags, reconcile, seasonality, timegrid
from tidewater.queries._base import EG, OD, OG, money, orders_daily, query, rounded, table

K = ["series"]

#: Holds for a day of the week, 1 for Monday.
_SUFFIX = "CASE WHEN isodow(ts) = 6 THEN '_Sat' WHEN isodow(ts) = 7 THEN '_Sun' WHEN isodow(ts) IN (1, 5) THEN '_Mon/Fri' ELSE '_WD' END"


@query(
    "weekday_suffixes",
    f"WITH {OD} SELECT series, CASE WHEN isodow(ts) >= 6 THEN '_WE' ELSE '_WD' END AS part, {_SUFFIX} AS grp, count(*) AS n, sum(y::DECIMAL(18,2))::DOUBLE AS y FROM od GROUP BY ALL",
)
def _(spark, d):
    o = orders_daily(spark, d)
    return o.groupBy("series", cal.weekday_weekend_suffix(F.col("ts")).alias("part"), cal.grouped_dow_suffix(F.col("ts")).alias("grp")).agg(F.count("*").alias("n"), money("y").alias("y"))


@query(
    "time_floor_ceil",
    "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour0, (CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END)::TIMESTAMP AS hour1, (CASE WHEN date_trunc('month', ts) = ts THEN ts ELSE date_trunc('month', ts) + INTERVAL 1 MONTH END)::TIMESTAMP AS month1, count(*) AS n FROM events GROUP BY ALL",
)
def _(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"))
    return e.groupBy(labels.floor_time(F.col("ts"), "H").alias("hour0"), labels.ceil_time(F.col("ts"), "H").alias("hour1"), labels.ceil_time(F.col("ts"), "MS").alias("month1")).agg(F.count("*").alias("n"))


@query("detrend_overall", f"WITH {OD} SELECT series, ts, round(y - avg(y) OVER (PARTITION BY series), 3) AS y FROM od")
def _(spark, d):
    return rounded(seasonality.detrend(orders_daily(spark, d), keys=K), 3)


@query("detrend_by_weekday", f"WITH {OD} SELECT series, ts, isodow(ts)::INTEGER AS dow, round(y - avg(y) OVER (PARTITION BY series, isodow(ts)), 3) AS y FROM od")
def _(spark, d):
    return rounded(seasonality.detrend(cal.add_time_features(orders_daily(spark, d), ["dow"]), "seasonal_average", "dow", K), 3)


_BUSY = "busy AS (SELECT o_orderstatus AS event_key, o_orderdate::DATE AS date FROM orders GROUP BY 1, 2 HAVING sum(o_totalprice::DECIMAL(18,2)) > 1000000)"


def _busy(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("event_key"), F.to_date("o_orderdate").alias("date")).agg(money("o_totalprice").alias("v"))
    return o.filter("v > 1000000").select("event_key", "date", F.lit("event").alias("event_name"))


@query(
    "shift_events",
    f"WITH {_BUSY} SELECT event_key || '_' || abs(o) || 'D_' || CASE WHEN o > 0 THEN 'after' ELSE 'before' END AS event_key, (date + o::INTEGER)::DATE AS date, 'event' AS event_name FROM busy, unnest([-7, 1, 2]) AS t(o)",
)
def _(spark, d):
    return events.shift_events(_busy(spark, d), [-7, 1, 2])


@query(
    "events_with_suffix",
    f"WITH {_BUSY}, w AS (SELECT event_key || CASE WHEN o < 0 THEN '_minus_' || -o WHEN o > 0 THEN '_plus_' || o ELSE '' END AS k, (date + o::INTEGER)::DATE AS date FROM busy, unnest([-1, 0, 1, 2]) AS t(o)) SELECT k || CASE WHEN isodow(date) >= 6 THEN '_WE' ELSE '_WD' END AS event_key, date, 'event' AS event_name FROM w",
)
def _(spark, d):
    return events.expand_with_suffix(_busy(spark, d), cal.weekday_weekend_suffix, 1, 2)


@query(
    "flexible_grouping",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DOUBLE, 2) AS revenue, quantile_cont(l_quantity, 0.25)::DOUBLE AS q25, quantile_cont(l_quantity, 0.75)::DOUBLE AS q75 FROM lineitem GROUP BY 1, 2",
)
def _(spark, d):
    net = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))
    aggs = {"n": F.count("*"), "revenue": F.round(F.sum("net").cast("double"), 2), "q": F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.75)))}
    return evaluation.flexible_grouping(table(spark, d, "lineitem"), {"net": net}, ["l_returnflag", "l_linestatus"], aggs, {"q": ["q25", "q75"]})


@query(
    "lags_of_two_columns",
    f"WITH {OG}, n AS (SELECT o_orderstatus AS series, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), g AS (SELECT og.series, og.ts, coalesce(y, 0) AS y, coalesce(n, 0) AS n FROM og LEFT JOIN n USING (series, ts)) SELECT series, ts, y, n, lag(y, 1) OVER w AS y_lag1, lag(y, 7) OVER w AS y_lag7, lag(n, 2) OVER w AS n_lag2 FROM g WINDOW w AS (PARTITION BY series ORDER BY ts)",
)
def _(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("series"), F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(money("o_totalprice").alias("y"), F.count("*").cast("double").alias("n"))
    g = timegrid.fill_gaps(o, "1 day", K).fillna({"y": 0.0, "n": 0.0})
    more = {**lags.lag_columns("y", [1, 7], K), **lags.lag_columns("n", [2], K)}
    return g.select("series", "ts", "y", "n", *[c.alias(k) for k, c in more.items()])


@query("canonical_daily", "WITH t AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y FROM orders GROUP BY 1) SELECT g.ts, t.y FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM t) g LEFT JOIN t USING (ts)")
def _(spark, d):
    o = table(spark, d, "orders").groupBy(F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(money("o_totalprice").alias("v"))
    return timegrid.canonicalise(o, "1 day", "day", "v").fit_df.select("ts", "y")


@query(
    "constrained_best",
    "WITH c AS (SELECT l_returnflag, l_linenumber, round(avg(l_discount), 9) AS gain, round(avg(l_quantity), 6) AS cost FROM lineitem GROUP BY 1, 2) SELECT * FROM c WHERE cost >= 25 ORDER BY gain DESC, cost DESC LIMIT 1",
)
def _(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("l_discount"), 9).alias("gain"), F.round(F.avg("l_quantity"), 6).alias("cost"))
    return detect.optimise_constrained(c, "gain", "cost", 25.0)


@query("row_functions", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double") for c in ("l_extendedprice", "l_discount")])
    return clean.apply_rows(li, lambda p, x: F.round(p * (1 - x), 6), ["l_extendedprice", "l_discount"], "net").select("l_orderkey", "l_linenumber", "net")


_NODES = """base AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS ts, 'r' || n_regionkey AS node, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
a AS (SELECT ts, node, v FROM base UNION ALL SELECT ts, 'all', sum(v::DECIMAL(18,2))::DOUBLE FROM base GROUP BY 1)"""


def _nodes(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.date_trunc("MONTH", "o_orderdate").cast("timestamp_ntz").alias("ts"), "o_totalprice")
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("ts", F.concat(F.lit("r"), "n_regionkey").alias("node")).agg(money("o_totalprice").alias("value"))
    return leaves.unionByName(leaves.groupBy("ts").agg(money("value").alias("value")).withColumn("node", F.lit("all")))


@query(
    "reconcile_errors",
    f"""WITH {_NODES}, f AS (SELECT ts, node, lag(v) OVER (PARTITION BY node ORDER BY ts) * CASE WHEN node = 'all' THEN 1.1 ELSE 1 END AS f FROM a), b AS (SELECT a.ts, node, v, f FROM a JOIN f USING (ts, node) WHERE f IS NOT NULL),
    s AS (SELECT ts, sum(f) AS f FROM b WHERE node <> 'all' GROUP BY 1), r AS (SELECT b.ts, b.node, v, CASE WHEN node = 'all' THEN s.f ELSE b.f END AS f FROM b JOIN s USING (ts))
    SELECT node, round(avg(abs(b.v - b.f) / abs(b.v)) * 100, 5) AS "MAPE_base", round(median(abs(b.v - b.f) / abs(b.v)) * 100, 5) AS "MedAPE_base", round(sqrt(avg((b.v - b.f) ** 2)), 3) AS "RMSE_base",
           round(avg(abs(r.v - r.f) / abs(r.v)) * 100, 5) AS "MAPE_reconciled", round(median(abs(r.v - r.f) / abs(r.v)) * 100, 5) AS "MedAPE_reconciled", round(sqrt(avg((r.v - r.f) ** 2)), 3) AS "RMSE_reconciled" FROM b JOIN r USING (ts, node) GROUP BY 1""",
)
def _(spark, d):
    actual = _nodes(spark, d)
    h, nodes = reconcile.Hierarchy([[5]]), ["all", *[f"r{k}" for k in range(5)]]
    base = actual.withColumn("value", F.lag("value").over(Window.partitionBy("node").orderBy("ts")) * F.when(F.col("node") == "all", 1.1).otherwise(1.0)).filter("value IS NOT NULL")
    fixed = reconcile.fit_reconciler(h, nodes, "bottom_up").apply(base)
    out = reconcile.evaluate_reconciled(actual, base, fixed, h, nodes)
    return out.select("node", *[F.round(c, 3 if c.startswith("RMSE") else 5).alias(c) for c in out.columns if c != "node"])


#: Hourly events numbered from the end, split into the last 48 hours and what is before.
STAGES = f"""WITH {EG}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS back FROM eg), tr AS (SELECT *, date_trunc('day', ts) AS d FROM n WHERE back > 48),
c AS (SELECT series, d, avg(y) AS y FROM tr GROUP BY 1, 2), s1 AS (SELECT series, isodow(d) AS w, avg(y) AS f FROM c GROUP BY 1, 2), a1 AS (SELECT series, avg(y) AS f FROM c GROUP BY 1),
r AS (SELECT tr.series, hour(ts) AS h, y - coalesce(s1.f, a1.f) AS y FROM tr LEFT JOIN s1 ON s1.series = tr.series AND s1.w = isodow(tr.d) JOIN a1 ON a1.series = tr.series), s2 AS (SELECT series, h, avg(y) AS f FROM r GROUP BY 1, 2), a2 AS (SELECT series, avg(y) AS f FROM r GROUP BY 1)
SELECT n.series, n.ts, n.y AS actual, round(coalesce(s1.f, a1.f) + coalesce(s2.f, a2.f), 6) AS forecast FROM n JOIN a1 USING (series) JOIN a2 USING (series) LEFT JOIN s1 ON s1.series = n.series AND s1.w = isodow(n.ts) LEFT JOIN s2 ON s2.series = n.series AND s2.h = hour(n.ts) WHERE back <= 48"""

#: Three seasonal means over four rolling origins; symmetric errors are null where both sides are 0 anywhere.
BENCHMARK = f"""WITH {EG}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS r, isodow(ts) AS w, hour(ts) AS h, isodow(ts) >= 6 AS we FROM eg), e AS (SELECT n.*, back FROM n, unnest([0, 1, 2, 3]) AS t(back)),
tr AS (SELECT * FROM e WHERE r > 24 * (back + 1) AND y IS NOT NULL), te AS (SELECT * FROM e WHERE r <= 24 * (back + 1) AND r > 24 * back AND y IS NOT NULL), o AS (SELECT series, back, avg(y) AS f FROM tr GROUP BY 1, 2),
f AS (SELECT 'dow_hr' AS config, te.series, te.y, coalesce(m.f, o.f) AS f FROM te JOIN o USING (series, back) LEFT JOIN (SELECT series, back, w, h, avg(y) AS f FROM tr GROUP BY ALL) m USING (series, back, w, h)
UNION ALL SELECT 'hour', te.series, te.y, coalesce(m.f, o.f) FROM te JOIN o USING (series, back) LEFT JOIN (SELECT series, back, h, avg(y) AS f FROM tr GROUP BY ALL) m USING (series, back, h)
UNION ALL SELECT 'hour_weekend', te.series, te.y, coalesce(m.f, o.f) FROM te JOIN o USING (series, back) LEFT JOIN (SELECT series, back, h, we, avg(y) AS f FROM tr GROUP BY ALL) m USING (series, back, h, we))
SELECT config, series, round(avg(abs(y - f)), 6) AS "MAE", round(sqrt(avg((y - f) ** 2)), 6) AS "RMSE", round(CASE WHEN min(abs(y) + abs(f)) > 0 THEN avg(100 * abs(y - f) / (abs(y) + abs(f))) END, 6) AS "sMAPE" FROM f GROUP BY 1, 2"""


@query("rank_scaled", "SELECT l_orderkey, l_linenumber, round(percent_rank() OVER (ORDER BY l_extendedprice), 9) AS price_rank, round(percent_rank() OVER (ORDER BY l_quantity), 9) AS quantity_rank FROM lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("price_rank"), F.col("l_quantity").cast("double").alias("quantity_rank"))
    return rounded(clean.scale_features(li, ["price_rank", "quantity_rank"], "QuantileTransformer"), 9)


@query("significant_digits", "WITH a AS (SELECT l_suppkey, avg(l_extendedprice)::DOUBLE AS x FROM lineitem GROUP BY 1), s AS (SELECT *, pow(10.0, greatest(2 - floor(log10(abs(x)))::INTEGER - 1, 0)::DOUBLE) AS k2, pow(10.0, greatest(7 - floor(log10(abs(x)))::INTEGER - 1, 0)::DOUBLE) AS k7 FROM a) SELECT l_suppkey, round(x * k2) / k2 AS two, round(round(x * k7) / k7, 6) AS seven FROM s")
def _(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg(F.col("l_extendedprice").cast("double")).alias("x"))
    return a.select("l_suppkey", cal.round_significant(F.col("x"), 2).alias("two"), F.round(cal.round_significant(F.col("x"), 7), 6).alias("seven"))


def _zone_sql(table_name: str, ts: str, zone: str) -> str:
    ahead = "date_diff('second', timezone('UTC', timezone('{z}', {t})), {t})"
    at = {k: ahead.format(z=zone, t=t) for k, t in {"now": "t", "jan": "make_timestamp(year(t), 1, 1, 0, 0, 0)", "jul": "make_timestamp(year(t), 7, 1, 0, 0, 0)"}.items()}
    return f"WITH x AS (SELECT date_trunc('day', {ts})::TIMESTAMP + INTERVAL 12 HOUR AS t, count(*) AS n FROM {table_name} GROUP BY 1) SELECT t AS ts, n, {at['now']}::BIGINT AS ahead, {at['now']} > least({at['jan']}, {at['jul']}) AS dst FROM x"


@query("zone_dst_orders", _zone_sql("orders", "o_orderdate", "America/New_York"))
def _(spark, d):
    o = table(spark, d, "orders").groupBy((F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz") + F.expr("interval 12 hours")).alias("ts")).agg(F.count("*").alias("n"))
    return o.select("ts", "n", cal.utc_offset_seconds(F.col("ts"), "America/New_York").alias("ahead"), cal.zone_dst(F.col("ts"), "America/New_York").alias("dst"))


@query("zone_dst_south", _zone_sql("events", "ts", "Australia/Sydney"))
def _(spark, d):
    e = table(spark, d, "events").groupBy((F.date_trunc("DAY", "ts").cast("timestamp_ntz") + F.expr("interval 12 hours")).alias("ts")).agg(F.count("*").alias("n"))
    return e.select("ts", "n", cal.utc_offset_seconds(F.col("ts"), "Australia/Sydney").alias("ahead"), cal.zone_dst(F.col("ts"), "Australia/Sydney").alias("dst"))


@query(
    "partition_future",
    f"""WITH {OD}, n AS (SELECT series, ts, row_number() OVER w AS i, count(*) OVER (PARTITION BY series) AS c FROM od WINDOW w AS (PARTITION BY series ORDER BY ts)),
    tr AS (SELECT series, min(ts) AS a, max(ts) AS b FROM n WHERE i > 10 AND i <= c - 40 GROUP BY 1), fu AS (SELECT series, ts FROM n WHERE i <= 20 OR i > c - 30 OR (i > c - 50 AND i <= c - 40)),
    p AS (SELECT series, ts, CASE WHEN ts < a THEN 'before' WHEN ts <= b THEN 'inside' WHEN ts > b THEN 'after' END AS part, b FROM fu LEFT JOIN tr USING (series)),
    g AS (SELECT series, b, min(ts) AS f FROM p WHERE part = 'after' GROUP BY 1, 2), e AS (SELECT series, f, unnest(generate_series(b + INTERVAL 1 DAY, f, INTERVAL 1 DAY)) AS ts FROM g)
    SELECT series, ts, part FROM p UNION ALL SELECT series, ts, 'gap' FROM e WHERE ts < f""",
)
def _(spark, d):
    w = Window.partitionBy("series")
    n = orders_daily(spark, d).withColumns({"i": F.row_number().over(w.orderBy("ts")), "c": F.count("*").over(w)})
    train, future = n.filter("i > 10 AND i <= c - 40"), n.filter("i <= 20 OR i > c - 30 OR (i > c - 50 AND i <= c - 40)")
    return timegrid.partition_future(train, future, "1 day", K)
