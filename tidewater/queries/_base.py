"""Registry, and the series that the queries work on (with their SQL as common table expressions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(c: str, digits: int = 2) -> Column:
    """Sum in decimals, so that it doesn't depend on the order of rows."""
    return F.sum(F.col(c).cast(f"decimal(18,{digits})")).cast("double")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def orders_daily(spark: SparkSession, d: str) -> DataFrame:
    """Value of the orders of a day, per status: (series, ts, y); days without orders have no row."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("series"), F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("ts"), "o_totalprice")
    return o.groupBy("series", "ts").agg(money("o_totalprice").alias("y"))


def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Sum of event values of an hour, per type."""
    e = table(spark, d, "events").select(F.col("event_type").alias("series"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts"), "value")
    return e.groupBy("series", "ts").agg(money("value", 4).alias("y"))


OD = "od AS (SELECT o_orderstatus AS series, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y FROM orders GROUP BY 1, 2)"
OG = OD + ", og AS (SELECT g.series, g.ts, od.y FROM (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM od GROUP BY series) g LEFT JOIN od USING (series, ts))"
EH = "eh AS (SELECT event_type AS series, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(value::DECIMAL(18,4))::DOUBLE AS y FROM events GROUP BY 1, 2)"
EG = EH + ", eg AS (SELECT g.series, g.ts, eh.y FROM (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM eh GROUP BY series) g LEFT JOIN eh USING (series, ts))"
