"""Forecast metrics: per row as columns, and over groups as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.schema import ACTUAL, FORECAST, LOWER, NULL_FORECAST, TIME, UPPER


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- per row


def residual(y: Column, p: Column) -> Column:
    return y - p


def absolute_error(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def squared_error(y: Column, p: Column) -> Column:
    return F.pow(y - p, F.lit(2))


def absolute_percent_error(y: Column, p: Column) -> Column:
    """100 |y - p| / |y|, null for y = 0."""
    return 100 * F.abs(y - p) / F.nullif(F.abs(y), F.lit(0.0))


def symmetric_percent_error(y: Column, p: Column) -> Column:
    """100 |y - p| / (|y| + |p|), null where both are 0."""
    return 100 * F.abs(y - p) / F.nullif(F.abs(y) + F.abs(p), F.lit(0.0))


def pinball(y: Column, p: Column, q: float) -> Column:
    return F.when(y < p, (1 - q) * (p - y)).otherwise(q * (y - p))


def outside_tolerance(y: Column, p: Column, rtol: float) -> Column:
    return (F.abs(p - y) > rtol * F.abs(y)).cast("double")


def within_bands(y: Column, lower: Column, upper: Column) -> Column:
    """1 strictly inside the band, else 0."""
    return ((y > lower) & (y < upper)).cast("double")


def interval_score(y: Column, lower: Column, upper: Column, coverage: float) -> Column:
    penalty = 2 / (1 - coverage)
    return upper - lower + F.when(y < lower, penalty * (lower - y)).when(y > upper, penalty * (y - upper)).otherwise(0.0)


# ---- aggregates; rows where either side is null don't count


def _pair(y: Column, p: Column) -> tuple[Column, Column]:
    ok = y.isNotNull() & p.isNotNull()
    return F.when(ok, y), F.when(ok, p)


def correlation(y: Column, p: Column) -> Column:
    """Pearson's; null if a side is constant."""
    y, p = _pair(y, p)
    return F.covar_pop(y, p) / F.nullif(F.stddev_pop(y) * F.stddev_pop(p), F.lit(0.0))


def r2(y: Column, p: Column) -> Column:
    y, p = _pair(y, p)
    return 1 - F.sum(squared_error(y, p)) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))


def mse(y: Column, p: Column) -> Column:
    return F.avg(squared_error(y, p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(absolute_error(y, p))


def median_absolute_error(y: Column, p: Column) -> Column:
    return F.median(absolute_error(y, p))


def _unless_zero(y: Column, made: Column) -> Column:
    return F.when(F.min(F.abs(y)) > 0, made)


def mape(y: Column, p: Column) -> Column:
    """Null if any actual value is 0."""
    y, p = _pair(y, p)
    return _unless_zero(y, F.avg(absolute_percent_error(y, p)))


def median_ape(y: Column, p: Column) -> Column:
    y, p = _pair(y, p)
    return _unless_zero(y, F.median(absolute_percent_error(y, p)))


def smape(y: Column, p: Column) -> Column:
    """Null if both sides are 0 anywhere."""
    y, p = _pair(y, p)
    return F.when(F.min(F.abs(y) + F.abs(p)) > 0, F.avg(symmetric_percent_error(y, p)))


def quantile_loss(y: Column, p: Column, q: float) -> Column:
    return F.avg(pinball(y, p, q))


def fraction_outside_tolerance(y: Column, p: Column, rtol: float) -> Column:
    return F.avg(outside_tolerance(y, p, rtol))


def fraction_within_bands(y: Column, lower: Column, upper: Column) -> Column:
    return F.avg(within_bands(y, lower, upper))


def band_width(y: Column, lower: Column, upper: Column) -> Column:
    """Mean width in percent of the actual value; null if any of those is 0."""
    return _unless_zero(y, F.avg(100 * F.abs(upper - lower) / F.abs(y)))


def mean_interval_score(y: Column, lower: Column, upper: Column, coverage: float) -> Column:
    return F.avg(interval_score(y, lower, upper, coverage))


def r2_null_model(y: Column, p: Column, p_null: Column) -> Column:
    """1 - loss / loss of the null model, squared errors."""
    return 1 - F.avg(squared_error(y, p)) / F.nullif(F.avg(squared_error(y, p_null)), F.lit(0.0))


#: Point metrics by short name.
POINT_METRICS = {
    "CORR": correlation,
    "R2": r2,
    "MSE": mse,
    "RMSE": rmse,
    "MAE": mae,
    "MedAE": median_absolute_error,
    "MAPE": mape,
    "MedAPE": median_ape,
    "sMAPE": smape,
    "Q80": lambda y, p: quantile_loss(y, p, 0.8),
    "Q95": lambda y, p: quantile_loss(y, p, 0.95),
    "Q99": lambda y, p: quantile_loss(y, p, 0.99),
    **{f"OutsideTolerance{k}p": (lambda y, p, k=k: fraction_outside_tolerance(y, p, k / 100)) for k in (1, 2, 3, 4, 5)},
}

ELEMENTWISE = {"residual": residual, "absolute_error": absolute_error, "squared_error": squared_error, "absolute_percent_error": absolute_percent_error, "symmetric_percent_error": symmetric_percent_error}


def evaluate(df: DataFrame, by: Sequence[str] = (), names: Sequence[str] | None = None, actual: str = ACTUAL, forecast: str = FORECAST) -> DataFrame:
    """Point metrics, one row per group, in one aggregation."""
    y, p = F.col(actual), F.col(forecast)
    return df.groupBy(*by).agg(*[POINT_METRICS[n](y, p).alias(n) for n in (names or POINT_METRICS)])


def evaluate_intervals(df: DataFrame, coverage: float, by: Sequence[str] = (), actual: str = ACTUAL, forecast: str = FORECAST, lower: str = LOWER, upper: str = UPPER) -> DataFrame:
    """Band width, coverage (whole, lower and upper half), its difference from the goal, and the interval score."""
    y, p, lo, hi = (F.col(c) for c in (actual, forecast, lower, upper))
    return df.groupBy(*by).agg(
        band_width(y, lo, hi).alias("PREDICTION_BAND_WIDTH"),
        fraction_within_bands(y, lo, hi).alias("PREDICTION_BAND_COVERAGE"),
        fraction_within_bands(y, lo, p).alias("LOWER_BAND_COVERAGE"),
        fraction_within_bands(y, p, hi).alias("UPPER_BAND_COVERAGE"),
        (fraction_within_bands(y, lo, hi) - coverage).alias("COVERAGE_DIFF"),
        mean_interval_score(y, lo, hi, coverage).alias("MIS"),
    )


def evaluate_against_null(df: DataFrame, by: Sequence[str] = (), actual: str = ACTUAL, forecast: str = FORECAST, null: str = NULL_FORECAST) -> DataFrame:
    return df.groupBy(*by).agg(r2_null_model(F.col(actual), F.col(forecast), F.col(null)).alias("R2_null_model_score"))


def evaluate_preaggregated(df: DataFrame, size: int, agg: str = "sum", names: Sequence[str] = ("MAE", "RMSE"), keys: Sequence[str] = (), ts: str = TIME, actual: str = ACTUAL, forecast: str = FORECAST) -> DataFrame:
    """Metrics over bins of ``size`` rows counted from the end of each series."""
    from tidewater.operators.timegrid import AGGREGATES

    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(F.col(ts).desc())) - 1, "_n": F.count("*").over(w)})
    bins = ranked.withColumn("_bin", F.floor(F.col("_r") / size)).filter((F.col("_bin") < F.floor(F.col("_n") / size)) | (F.col("_n") < size))
    binned = bins.groupBy(*keys, "_bin").agg(AGGREGATES[agg](F.col(actual)).alias(actual), AGGREGATES[agg](F.col(forecast)).alias(forecast))
    return evaluate(binned, keys, names, actual, forecast)


def valid_rows(df: DataFrame, reference: Sequence[str], leading_only: bool = False, keep_inf: bool = False, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Rows whose reference columns are all there (and finite); with ``leading_only`` those from the first such row on."""
    ok = F.lit(True)
    for c in reference:
        x = F.col(c)
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.lit(True) if keep_inf else F.abs(x) != float("inf"))
    if not leading_only:
        return df.filter(ok)
    first = F.min(F.when(ok, F.col(ts))).over(Window.partitionBy(*keys))
    kept = df.withColumn("_first", first).filter(F.col(ts) >= F.col("_first")).drop("_first")
    if keep_inf:
        return kept
    finite = F.lit(True)
    for c in reference:
        finite = finite & (F.col(c).isNull() | (F.abs(c) != float("inf")))
    return kept.filter(finite)


def compare_frames(a: DataFrame, b: DataFrame, index: Sequence[str], cols: Sequence[str], relative: bool = False) -> DataFrame:
    """Differences b - a of columns on a common index, with ``relative`` over |a|."""
    joined = a.alias("a").join(b.alias("b"), list(index))
    diff = lambda c: F.col(f"b.{c}") - F.col(f"a.{c}")
    return joined.select(*index, *[(diff(c) / F.nullif(F.abs(F.col(f"a.{c}")), F.lit(0.0)) if relative else diff(c)).alias(f"{c}_diff") for c in cols])
