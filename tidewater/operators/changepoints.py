"""Changepoints of trend and seasonality by adaptive lasso, and level shifts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.calendar import changepoint_terms, continuous_year, fourier_terms
from tidewater.operators.regression import Fit, contiguous_folds, fit_adaptive_lasso, fit_adaptive_lasso_cv, fit_ridge, gram
from tidewater.operators.timegrid import resample
from tidewater.schema import TIME, VALUE


def evenly_spaced_times(df: DataFrame, n: int, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """(keys, k, ts): the times at row floor(k * rows / (n + 1)), k = 1 .. n."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(ts)) - 1, "_n": F.count("*").over(w)})
    return ranked.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).filter(F.col("_i") == F.floor(F.col("k") * F.col("_n") / (n + 1))).select(*keys, "k", ts)


def first_time_from(df: DataFrame, dates: DataFrame, ts: str = TIME, date: str = "date") -> DataFrame:
    """For each date the first time at or after it; dates after the last time have none. ``dates`` is a small table."""
    d = dates.select(F.col(date).cast("timestamp_ntz").alias("_d")).distinct()
    return df.select(ts).join(F.broadcast(d), F.col(ts) >= F.col("_d")).groupBy("_d").agg(F.min(ts).alias(ts)).withColumnRenamed("_d", date)


def auto_parameters(n_points: int, step_days: float, yearly_order: int) -> dict:
    """Resampling, potential changepoints and distances by length and spacing of the series."""
    span = n_points * step_days
    freq = None if step_days >= 7 else "7D" if span >= 700 else "3D" if span >= 300 else "D"
    n_agg = n_points if freq is None else int(span // int(freq[:-1] or 1))
    potential = max(0, min(100, n_agg - 2 * yearly_order - 1))
    least = 14 if step_days < 1 else 30 if step_days <= 7 else 2 * step_days
    return {"freq": freq, "potential": potential, "min_distance_days": max(2 * step_days, least)}


def filter_close(candidates: Sequence[tuple[int, float]], least: int) -> list[int]:
    """Of (index, size) candidates those that stay when larger ones win within ``least`` indices; freed ones come back."""
    kept: list[int] = []
    for i, _ in sorted(candidates, key=lambda c: (-abs(c[1]), c[0])):
        if all(abs(i - k) >= least for k in kept):
            kept.append(i)
    return sorted(kept)


def combine_changepoints(detected: Sequence[dt.datetime], custom: Sequence[dt.datetime], least: dt.timedelta, prefer_custom: bool = True) -> list[dt.datetime]:
    """Both lists, without those of the other list that come closer than ``least`` to the preferred."""
    first, second = (custom, detected) if prefer_custom else (detected, custom)
    kept = list(first)
    kept += [d for d in second if all(abs(d - k) >= least for k in first)]
    return sorted(set(kept))


def trend_changepoints(df: DataFrame, n_potential: int = 20, yearly_order: int = 8, freq: str | None = "7D", strength: float | None = 0.6, min_distance_days: float = 30, skip_last_days: float = 0, ts: str = TIME, value: str = VALUE) -> list[dt.datetime]:
    """Times at which the trend of one series changes.

    The series is resampled; hinges at evenly spaced times and yearly Fourier terms are fitted by ridge, then by adaptive
    lasso with weights from it (no weight on the seasonal terms' penalty but their own size); hinges that stay are
    thinned to the largest within the least distance. Without a ``strength`` the one that does best on held-out stretches is taken.
    """
    base = resample(df.filter(F.col(value).isNotNull()), freq, {value: F.avg(value)}, (), ts) if freq else df.filter(F.col(value).isNotNull())
    times = [r[ts] for r in evenly_spaced_times(base, n_potential, (), ts).orderBy("k").collect()]
    span = base.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    times = [t for t in times if t <= span.b - dt.timedelta(days=skip_last_days)]
    if not times:
        return []
    ct = F.col("_ct")
    origin = _decimal_year(span.a)
    based = base.withColumn("_ct", continuous_year(F.col(ts)) - origin)
    columns = {"Intercept": F.lit(1.0), "ct1": ct}
    columns |= changepoint_terms([_decimal_year(t) - origin for t in times], ct, names=[f"changepoint{k}" for k in range(len(times))])
    columns |= fourier_terms("ct1", 1.0, yearly_order, "yearly", ct)
    fit = _select(based, columns, F.col(value), strength, F.col(ts))
    at = [k for k, n in enumerate(fit.names) if n.startswith("changepoint")]
    found = [(k, fit.beta[i]) for k, i in enumerate(at) if abs(fit.beta[i]) > 1e-12]
    days = (span.b - span.a).total_seconds() / 86400 / max(1, n_potential + 1)
    return [times[k] for k in filter_close(found, max(1, int(np.ceil(min_distance_days / days))))]


def _select(df: DataFrame, columns: dict, response, strength: float | None, order, folds: int = 5) -> Fit:
    if strength is None:
        return fit_adaptive_lasso_cv(contiguous_folds(df, columns, response, folds, order))
    g = gram(df, columns, response)
    return fit_adaptive_lasso(g, fit_ridge(g, 1.0).beta, strength)


def _decimal_year(t: dt.datetime) -> float:
    start, end = dt.datetime(t.year, 1, 1), dt.datetime(t.year + 1, 1, 1)
    return t.year + (t - start) / (end - start)


def seasonality_changepoints(df: DataFrame, components: Sequence[tuple[str, float, int, str]], n_potential: int = 10, strength: float | None = 0.6, trend: Sequence[dt.datetime] = (), freq: str | None = "D", ts: str = TIME, value: str = VALUE) -> dict[str, list[dt.datetime]]:
    """Times at which the size of a seasonal component changes: Fourier terms cut off before each potential time, by
    adaptive lasso over the series less its trend. ``components`` are (column, period, order, name) of calendar features."""
    from tidewater.functions.calendar import add_time_features

    base = resample(df.filter(F.col(value).isNotNull()), freq, {value: F.avg(value)}, (), ts) if freq else df.filter(F.col(value).isNotNull())
    span = base.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    origin = _decimal_year(span.a)
    base = add_time_features(base, sorted({c for c, *_ in components} | {"ct1"}), ts, origin)
    hinge = {"Intercept": F.lit(1.0), "ct1": F.col("ct1")} | changepoint_terms([_decimal_year(t) - origin for t in trend], F.col("ct1"))
    g = gram(base, hinge, F.col(value))
    from tidewater.operators.regression import fit_ols, linear

    detrended = base.withColumn("_r", F.col(value) - linear(hinge, fit_ols(g).coefficients()))
    times = [r[ts] for r in evenly_spaced_times(base, n_potential, (), ts).orderBy("k").collect()]
    columns = {"Intercept": F.lit(1.0)}
    for col, period, order, name in components:
        terms = fourier_terms(col, period, order, name)
        columns |= terms
        for k, t in enumerate(times):
            columns |= {f"{n}_cp{k}": F.when(F.col(ts) >= F.lit(t), c).otherwise(0.0) for n, c in terms.items()}
    fit = _select(detrended, columns, F.col("_r"), strength, F.col(ts)).coefficients()
    out = {}
    for _, _, _, name in components:
        size = [sum(abs(b) for n, b in fit.items() if f"_{name}_cp" in n and n.endswith(f"_cp{k}")) for k in range(len(times))]
        out[name] = [times[k] for k in filter_close([(k, s) for k, s in enumerate(size) if s > 1e-12], 1)]
    return out


def estimate_trend(df: DataFrame, dates: Sequence[dt.datetime], yearly_order: int = 8, keys: Sequence[str] = (), algorithm: str = "ridge", params: dict | None = None, ts: str = TIME, value: str = VALUE) -> DataFrame:
    """(keys, ts, y, trend, seasonality): the trend of each series with the detected times only, fitted anew beside a yearly season.

    The penalty that chose the times has made their sizes too small; the second fit has no such columns to hold down.
    """
    from tidewater.operators import series_models
    from tidewater.operators.linear_model import ModelSpec

    spec = ModelSpec(changepoints=sorted(dates), seasonality={"yearly": yearly_order} if yearly_order else {}, algorithm=algorithm, params={"alpha": 1.0} if params is None and algorithm == "ridge" else params or {})
    parts = series_models.fitted_components(series_models.fit_series(df, spec, keys, ts=ts, value=value), ts=ts, value=value)
    return parts.select(*keys, ts, value, (F.col("Intercept") + F.col("trend")).alias("trend"), "seasonality")


def estimate_seasonality(df: DataFrame, seasonality: dict[str, int], dates: dict[str, Sequence[dt.datetime]], trend: Sequence[dt.datetime] = (), keys: Sequence[str] = (), algorithm: str = "ridge", params: dict | None = None, ts: str = TIME, value: str = VALUE) -> DataFrame:
    """(keys, ts, y, trend, one column per component): seasonal components with the detected times only, each part fitted anew.

    ``seasonality`` are orders by component, ``dates`` the times from which a component has another shape.
    """
    from tidewater.operators import series_models
    from tidewater.operators.linear_model import ModelSpec

    spec = ModelSpec(changepoints=sorted(trend), seasonality=dict(seasonality), seasonality_changepoints={k: sorted(v) for k, v in dates.items()}, algorithm=algorithm, params={"alpha": 1.0} if params is None and algorithm == "ridge" else params or {})
    groups = {name: rf"(?:sin|cos)\d+_\w+?_{name}(?:_cp\d+)?$" for name in seasonality}
    parts = series_models.fitted_components(series_models.fit_series(df, spec, keys, ts=ts, value=value), groups, "rest", ts, value)
    return parts.select(*keys, ts, value, (F.col("Intercept") + F.col("rest")).alias("trend"), *seasonality)


def level_shifts(df: DataFrame, z: float = 3.0, keys: Sequence[str] = (), ts: str = TIME, value: str = VALUE) -> DataFrame:
    """(keys, start_time, end_time): runs of rows whose change from the row before is ``z`` standard deviations (sample) from the mean change."""
    w, every = Window.partitionBy(*keys).orderBy(ts), Window.partitionBy(*keys)
    changed = df.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w))).withColumn("_pos", F.row_number().over(w))
    marked = changed.withColumn("_z", (F.col("_d") - F.avg("_d").over(every)) / F.nullif(F.stddev_samp("_d").over(every), F.lit(0.0))).filter(F.col("_z") > z)
    island = marked.withColumn("_g", F.col("_pos") - F.row_number().over(w))
    return island.groupBy(*keys, "_g").agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time")).drop("_g")


def step_regressors(df: DataFrame, shifts: Sequence[tuple[dt.datetime, dt.datetime]], ts: str = TIME) -> DataFrame:
    """Adds ctp_{date}: 0 before the middle of a shift, 1 from it on; also right for rows of the future."""
    cols = {}
    for a, b in shifts:
        mid = a + (b - a) / 2
        cols[f"ctp_{mid:%Y_%m_%d_%H}"] = F.when(F.col(ts) >= F.lit(mid), 1).otherwise(0)
    return df.withColumns(cols)
