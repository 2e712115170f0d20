"""Forecasters that need no regression: seasonal means, lags and null models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.lags import array_median
from tidewater.operators.timegrid import AGGREGATES
from tidewater.schema import FORECAST, TIME, VALUE


def similarity_forecast(train: DataFrame, future: DataFrame, match: Sequence[str], agg: str = "mean", keys: Sequence[str] = (), value: str = VALUE, recent: int | None = None, ts: str = TIME) -> DataFrame:
    """Each future row gets the aggregate of the training rows with equal ``match`` columns (the ``recent`` latest of them),
    or of the whole series where there is none."""
    known = train.filter(F.col(value).isNotNull())
    picked = known
    if recent is not None:
        picked = known.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, *match).orderBy(F.col(ts).desc()))).filter(F.col("_r") <= recent)
    own = picked.groupBy(*keys, *match).agg(AGGREGATES[agg](F.col(value)).alias("_own"))
    overall = known.groupBy(*keys).agg(AGGREGATES[agg](F.col(value)).alias("_all"))
    joined = future.join(own, [*keys, *match], "left")
    joined = joined.join(overall, list(keys), "left") if keys else joined.crossJoin(F.broadcast(overall))
    return joined.withColumn(FORECAST, F.coalesce("_own", "_all")).drop("_own", "_all")


#: Shifts of the time by a number of units.
_UNITS = {"minute": "minutes", "hour": "hours", "day": "days", "week": "weeks", "month": "months", "year": "years"}


def _back(ts: Column, unit: str, n: int) -> Column:
    return ts - F.expr(f"interval {n} {_UNITS[unit]}")


def _over(a: Column, agg: str) -> Column:
    some = F.nullif(F.size(a), F.lit(0))
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return {"mean": lambda: total / some, "median": lambda: array_median(a), "minimum": lambda: F.array_min(a), "maximum": lambda: F.array_max(a), "sum": lambda: F.when(some.isNotNull(), total)}[agg]()


def lag_forecast(history: DataFrame, future: DataFrame, lags: Sequence[int], unit: str = "week", agg: str = "mean", keys: Sequence[str] = (), rounds: int | None = None, ts: str = TIME, value: str = VALUE) -> DataFrame:
    """The aggregate of the values ``lags`` units before; where those lie in the future, of forecasts made in earlier rounds.

    ``rounds`` is 1 plus the times that the smallest lag fits between the end of history and the last future row; by default
    it is worked out from the two. Every round is one join per call; only what isn't known yet is joined again.
    """
    if min(lags) <= 0:
        raise ValueError("lags are positive")
    if rounds is None:
        end = history.filter(F.col(value).isNotNull()).agg(F.max(ts).alias("t")).first().t
        span = future.agg(F.max(ts).alias("t")).first().t
        rounds, step = 1, min(lags)
        seconds = {"minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 28 * 86400, "year": 365 * 86400}[unit] * step
        if end is not None and span is not None:
            rounds = max(1, -(-int((span - end).total_seconds()) // seconds))
    known = history.select(*keys, ts, F.col(value).alias("_v"))
    todo = future.select(*keys, ts)
    for _ in range(rounds):
        asked = todo.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in lags])))
        source = F.coalesce(*[F.when(F.col("_k") == k, _back(F.col(ts), unit, k)) for k in lags])
        values = asked.withColumn("_t", source).join(known.select(*keys, F.col(ts).alias("_t"), "_v"), [*keys, "_t"], "left")
        made = values.groupBy(*keys, ts).agg(F.collect_list("_v").alias("_a")).withColumn("_v", _over(F.col("_a"), agg)).drop("_a")
        known = history.select(*keys, ts, F.col(value).alias("_v")).unionByName(made.filter("_v is not null"))
    return future.join(made.withColumnRenamed("_v", FORECAST), [*keys, ts], "left")


def null_forecast(train: DataFrame, future: DataFrame, strategy: str = "mean", constant: float | None = None, quantile: float | None = None, keys: Sequence[str] = (), value: str = VALUE, out: str = "forecast_null") -> DataFrame:
    """One number per series: mean, median, a quantile or a constant."""
    if strategy == "constant":
        return future.withColumn(out, F.lit(float(constant)))
    made = {"mean": F.avg(value), "median": F.median(value), "quantile": F.percentile(value, F.lit(quantile))}[strategy]
    one = train.groupBy(*keys).agg(made.alias(out))
    return future.join(one, list(keys), "left") if keys else future.crossJoin(F.broadcast(one))


def horizon_blocks(future: DataFrame, blocks: Sequence[tuple[int, str]], keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Adds model: which of the models answers a future row, by its place in the horizon; (length, name) in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(ts))
    model, end = F.lit(None).cast("string"), 0
    for length, name in blocks:
        model = F.when((F.col("_h") > end) & (F.col("_h") <= end + length), name).otherwise(model)
        end += length
    return future.withColumn("_h", place).withColumn("model", model).drop("_h")


def combine_stages(stages: Sequence[DataFrame], fine: DataFrame, bins: Sequence[Column], keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Sum of stage forecasts: each fine row meets the stage's forecast of its bin."""
    out = fine.withColumn(FORECAST, F.lit(0.0))
    for k, (stage, start) in enumerate(zip(stages, bins, strict=True)):
        coarse = stage.select(*keys, F.col(ts).alias("_bin"), F.col(FORECAST).alias(f"_f{k}"))
        out = out.withColumn("_bin", start).join(coarse, [*keys, "_bin"], "left").withColumn(FORECAST, F.col(FORECAST) + F.col(f"_f{k}")).drop("_bin", f"_f{k}")
    return out
