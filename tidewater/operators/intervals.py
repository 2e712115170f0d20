"""Conditional residual intervals: residual distributions by slice, with fallbacks, applied to forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.schema import ERR_STD, QUANTILES


def slice_distributions(df: DataFrame, residual: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation (sample) and quantiles less the mean of each slice: exact, with linear interpolation."""
    stats = df.filter(F.col(residual).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(residual).alias("mean"), F.stddev_samp(residual).alias("std"), F.min(residual).alias("min"), F.max(residual).alias("max"), F.percentile(residual, F.array(*[F.lit(q) for q in quantiles])).alias("_q"))
    return stats.withColumn("qs", F.transform("_q", lambda q: q - F.col("mean"))).drop("_q")


def normal_quantiles(std: Column, quantiles: Sequence[float], mean: Column | float = 0.0) -> Column:
    """Quantiles of a normal distribution as an array."""
    z = [NormalDist().inv_cdf(q) for q in quantiles]
    m = F.lit(mean) if isinstance(mean, float) else mean
    return F.array(*[m + F.lit(x) * std for x in z])


def offset_array(qs: Column, by: Column) -> Column:
    return F.transform(qs, lambda q: q + by)


def clip_array(qs: Column, lower: float | None, upper: float | None) -> Column:
    def clip(q: Column) -> Column:
        q = F.greatest(q, F.lit(lower)) if lower is not None else q
        return F.least(q, F.lit(upper)) if upper is not None else q

    return F.transform(qs, clip)


@dataclass
class IntervalModel:
    """Residual quantiles: one row per large enough slice, and one row to fall back to."""

    slices: DataFrame
    fallback: DataFrame
    by: list[str]
    quantiles: list[float]


def fit_intervals(df: DataFrame, residual: str, quantiles: Sequence[float] = (0.025, 0.975), by: Sequence[str] = (), method: str = "normal_fit", min_rows: int = 5, small_quantile: float = 0.98, scale: float = 1.0) -> IntervalModel:
    """Distribution per slice. Slices of fewer than ``min_rows`` rows fall back to the large slice whose rank by deviation is
    nearest to ``small_quantile``; without any large slice to all rows together.

    The rank is the slice's place among the large slices over their number.
    """

    def shaped(stats: DataFrame) -> DataFrame:
        spread = normal_quantiles(F.col("std"), quantiles) if method == "normal_fit" else F.col("qs")
        return stats.withColumn("qs", F.transform(spread, lambda q: q * scale)).withColumn(ERR_STD, F.col("std") * scale)

    overall = shaped(slice_distributions(df, residual, quantiles)).select("qs", ERR_STD)
    if not by:
        return IntervalModel(overall, overall, [], list(quantiles))
    large = shaped(slice_distributions(df, residual, quantiles, by)).filter((F.col("n") >= min_rows) & F.col(ERR_STD).isNotNull())
    rank = F.row_number().over(Window.orderBy("std", *by)) / F.count("*").over(Window.partitionBy())  # one row per slice
    nearest = large.withColumn("_d", F.abs(rank - small_quantile)).orderBy("_d", *by).limit(1).select("qs", ERR_STD, F.lit(0).alias("_p"))
    fallback = nearest.unionByName(overall.withColumn("_p", F.lit(1))).orderBy("_p").limit(1).drop("_p")
    return IntervalModel(large.select(*by, "qs", ERR_STD), fallback, list(by), list(quantiles))


def apply_intervals(df: DataFrame, model: IntervalModel, forecast: str = "forecast", scaler: Column | None = None, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """Adds quantile_summary (forecast plus residual quantiles, scaled and clipped) and err_std."""
    back = model.fallback.select(F.col("qs").alias("_fq"), F.col(ERR_STD).alias("_fs"))
    joined = df.crossJoin(F.broadcast(back))  # one row
    if model.by:
        joined = joined.join(model.slices.select(*model.by, F.col("qs").alias("_q"), F.col(ERR_STD).alias("_s")), model.by, "left")
    else:
        joined = joined.withColumns({"_q": F.col("_fq"), "_s": F.col("_fs")})
    times = F.lit(1.0) if scaler is None else scaler
    qs = offset_array(F.transform(F.coalesce("_q", "_fq"), lambda q: q * times), F.col(forecast))
    return joined.withColumns({QUANTILES: clip_array(qs, lower, upper) if lower is not None or upper is not None else qs, ERR_STD: F.coalesce("_s", "_fs") * times}).drop("_q", "_s", "_fq", "_fs")


def with_bounds(df: DataFrame, lower: str = "forecast_lower", upper: str = "forecast_upper") -> DataFrame:
    return df.withColumns({lower: F.element_at(QUANTILES, 1), upper: F.element_at(QUANTILES, -1)})


def uncertainty_defaults(seconds: float, coverage: float | None) -> dict | None:
    """Slices by weekday and hour for daily data and finer, quantiles from the coverage."""
    if coverage is None:
        return None
    return {"by": ["dow_hr"] if seconds <= 86400 else [], "quantiles": [(1 - coverage) / 2, (1 + coverage) / 2], "method": "normal_fit", "min_rows": 5, "small_quantile": 0.98}


def quantile_model(df: DataFrame, columns: dict[str, Column], residual: str, quantiles: Sequence[float]) -> dict[float, dict[str, float]]:
    """Coefficients of residual quantiles over features (trend, season), one quantile regression each."""
    from tidewater.operators.regression import fit_quantile

    return {q: fit_quantile(df, columns, F.col(residual), q).coefficients() for q in quantiles}


def apply_quantile_model(df: DataFrame, columns: dict[str, Column], model: dict[float, dict[str, float]], forecast: str = "forecast") -> DataFrame:
    """Adds quantile_summary: forecast plus fitted residual quantiles, in order."""
    from tidewater.operators.regression import linear

    return df.withColumn(QUANTILES, F.array_sort(F.array(*[F.col(forecast) + linear(columns, b) for b in model.values()])))
