"""Lags and aggregated lags as window expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.schema import TIME, VALUE

#: Named aggregates of the non-null values of an array.
_OVER = {
    "mean": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0)),
    "minimum": F.array_min,
    "maximum": F.array_max,
    "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x),
    "median": lambda a: array_median(a),
}


def array_median(a: Column) -> Column:
    """Median of an array without nulls, null for an empty one."""
    s, n = F.array_sort(a), F.nullif(F.size(a), F.lit(0))
    low, high = F.try_element_at(s, F.floor((n + 1) / 2).cast("int")), F.try_element_at(s, F.floor(n / 2).cast("int") + 1)
    return (low + high) / 2


def lag_columns(value: str, orders: Sequence[int], keys: Sequence[str] = (), ts: str = TIME) -> dict[str, Column]:
    w = Window.partitionBy(*keys).orderBy(ts)
    return {f"{value}_lag{k}": F.lag(value, k).over(w) for k in orders}


def aggregated_lag_columns(value: str, sets: Sequence[Sequence[int]] = (), intervals: Sequence[tuple[int, int]] = (), agg: str = "mean", keys: Sequence[str] = (), ts: str = TIME) -> dict[str, Column]:
    """Aggregates over sets of lags and over runs of lags, of those that are there."""
    w = Window.partitionBy(*keys).orderBy(ts)
    label = "avglag" if agg == "mean" else f"{agg}lag"
    out: dict[str, Column] = {}
    for orders in sets:
        if len(set(orders)) != len(orders):
            raise ValueError(f"repeated lag in {orders}")
        lags = F.filter(F.array(*[F.lag(value, k).over(w).cast("double") for k in orders]), lambda x: x.isNotNull())
        out[f"{value}_{label}_" + "_".join(map(str, orders))] = _OVER[agg](lags)
    natives = {"mean": F.avg, "minimum": F.min, "maximum": F.max, "sum": F.sum, "median": F.median}
    for interval in intervals:
        if len(interval) != 2:
            raise ValueError(f"an interval has two ends: {interval}")
        a, b = interval
        out[f"{value}_{label}_{a}_to_{b}"] = natives[agg](value).over(w.rowsBetween(-b, -a))
    return out


def lag_span(orders: Sequence[int] = (), sets: Sequence[Sequence[int]] = (), intervals: Sequence[tuple[int, int]] = ()) -> tuple[int, int]:
    """Smallest and largest lag in use."""
    every = [*orders, *(k for s in sets for k in s), *(k for i in intervals for k in i)]
    return (min(every), max(every)) if every else (0, 0)


def fill_both_ways(value: str, keys: Sequence[str] = (), ts: str = TIME, forward_first: bool = False) -> Column:
    """The next known value, else the one before (the other way round with ``forward_first``)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    behind = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(behind, ahead) if forward_first else F.coalesce(ahead, behind)


def add_lags(df: DataFrame, value: str = VALUE, orders: Sequence[int] = (), sets: Sequence[Sequence[int]] = (), intervals: Sequence[tuple[int, int]] = (), keys: Sequence[str] = (), ts: str = TIME, past: DataFrame | None = None, fill: bool = True) -> DataFrame:
    """The rows with all lag columns; ``past`` rows come before and go again; with ``fill`` nulls are filled before lagging."""
    both = df.withColumn("_own", F.lit(True))
    if past is not None:
        both = both.unionByName(past.select(*keys, ts, value).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_v", fill_both_ways(value, keys, ts) if fill else F.col(value))
    exprs = lag_columns("_v", orders, keys, ts) | aggregated_lag_columns("_v", sets, intervals, "mean", keys, ts)
    return both.withColumns({value + k[2:]: c for k, c in exprs.items()}).filter("_own").drop("_own", "_v")


def similar_lag(days_per_period: float) -> int | None:
    """Periods in a week, rounded up; None if it isn't more than one."""
    n = -(-7 // days_per_period)
    return int(n) if n > 1 else None


def auto_lags(days_per_period: float, horizon: int, simulation: bool) -> dict | None:
    """Default autoregressive terms by horizon: recent lags, means over one and two weeks of lags, and the same place in three weeks."""
    s = similar_lag(days_per_period)
    if horizon * days_per_period > 30 or s is None:
        return None
    if simulation:
        return {"orders": [1, 2, 3], "sets": [[s, 2 * s, 3 * s]], "intervals": [(1, s), (s + 1, 2 * s)]}
    p = -(-horizon // s) * s
    return {"orders": [horizon, horizon + 1, horizon + 2], "sets": [[p, p + s, p + 2 * s]], "intervals": [(horizon, horizon + s - 1), (horizon + s, horizon + 2 * s - 1)]}


def auto_lagged_regressor(days_per_period: float, horizon: int) -> dict | None:
    """Default lags of a regressor that isn't known ahead: the same place in the first week beyond the horizon, its mean with
    that of the two weeks before, and the mean of the latest week that is known. None beyond 30 days."""
    if horizon * days_per_period > 30:
        return None
    s = similar_lag(days_per_period)
    if s is None:
        return {"orders": [horizon]}
    p = -(-horizon // s) * s
    return {"orders": [1 if horizon == 1 else p], "sets": [[p, p + s, p + 2 * s]], "intervals": [(horizon, horizon + s - 1)]}


def lagged_correlations(df: DataFrame, regressors: Sequence[str], orders: Sequence[int], keys: Sequence[str] = (), ts: str = TIME, value: str = VALUE) -> DataFrame:
    """(keys, regressor, lag, n, correlation) of the value with each regressor so many rows before, all from one pass of sums."""
    pairs = [(r, k) for r in regressors for k in orders]
    w = Window.partitionBy(*keys).orderBy(ts)
    lagged = df.select(*keys, F.col(value).cast("double").alias("_y"), *[F.lag(F.col(r).cast("double"), k).over(w).alias(f"_{i}") for i, (r, k) in enumerate(pairs)])
    both = [(F.count(F.col("_y") + F.col(f"_{i}")), F.corr("_y", f"_{i}")) for i in range(len(pairs))]
    rows = [F.struct(F.lit(r).alias("regressor"), F.lit(k).alias("lag"), n.alias("n"), c.alias("correlation")) for (r, k), (n, c) in zip(pairs, both, strict=True)]
    return lagged.groupBy(*keys).agg(F.array(*rows).alias("_r")).select(*keys, F.explode("_r").alias("_r")).select(*keys, "_r.*")


def best_lags(correlations: DataFrame, horizon: int, keys: Sequence[str] = (), most: int = 1) -> DataFrame:
    """Of each series and regressor the ``most`` lags with the largest correlation by size, none shorter than the horizon."""
    usable = correlations.filter((F.col("lag") >= horizon) & F.col("correlation").isNotNull())
    w = Window.partitionBy(*keys, "regressor").orderBy(F.abs("correlation").desc(), "lag")
    return usable.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
