"""Feature-regression forecaster: trend, changepoints, seasonality, events, autoregression and regressors in one linear model.

Features are column expressions; a fit is one aggregation to a Gram matrix per model. Where the horizon needs values that are
forecasts themselves, rows are predicted one after another per series (and per simulated path) in grouped pandas functions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.calendar import add_time_features, changepoint_terms, fourier_terms
from tidewater.operators import intervals, lags
from tidewater.operators.events import add_events
from tidewater.operators.regression import Design, Fit, Gram, breakdown, design, fit_by_name, gram, predict, prediction_scale, summary
from tidewater.operators.seasonality import COMPONENTS, drop_collinear
from tidewater.schema import FORECAST, TIME, VALUE


@dataclass
class ModelSpec:
    """What goes into the model."""

    growth: str = "ct1"
    changepoints: list[dt.datetime] = field(default_factory=list)
    seasonality: dict[str, int] = field(default_factory=lambda: {"weekly": 3, "yearly": 8})
    event_keys: list[str] = field(default_factory=list)
    autoreg: dict | None = None  # orders, sets, intervals
    regressors: list[str] = field(default_factory=list)
    lagged_regressors: dict[str, dict] = field(default_factory=dict)
    extra_terms: list[str] = field(default_factory=list)  # formula terms, such as "C(dow)" or "is_weekend:ct1"
    algorithm: str = "ridge"
    params: dict = field(default_factory=lambda: {"alpha": 1.0})
    uncertainty: dict | None = None
    lower: float | None = None
    upper: float | None = None
    interval: str = "1 day"
    drop_terms: list[str] = field(default_factory=list)
    #: Times from which a seasonal component has a shape of its own, by component.
    seasonality_changepoints: dict[str, list[dt.datetime]] = field(default_factory=dict)


@dataclass
class LinearModel:
    """A fitted model: its design columns, coefficients, sums and residual intervals."""

    spec: ModelSpec
    origin: float
    design: Design
    fit: Fit
    gram: Gram | None
    ranges: dict[str, tuple[float, float]]
    ci: intervals.IntervalModel | None
    train: DataFrame
    events: DataFrame | None
    n: int

    def coefficient_summary(self) -> tuple[list[dict], dict]:
        return summary(self.gram, self.fit)


_CALENDAR = ["tod", "tow", "tom", "toq", "toy", "ct1", "ct2", "ct3", "ct_sqrt", "ct_root3", "dow", "str_dow", "hour", "dow_hr", "is_weekend", "month", "dow_grouped", "quarter"]


def _decimal(t: dt.datetime) -> float:
    start, end = dt.datetime(t.year, 1, 1), dt.datetime(t.year + 1, 1, 1)
    return t.year + (t - start) / (end - start)


def _features(df: DataFrame, spec: ModelSpec, origin: float, events: DataFrame | None, ts: str) -> DataFrame:
    df = add_time_features(df, [c for c in _CALENDAR if c not in df.columns], ts, origin)
    if events is not None and spec.event_keys:
        df = add_events(df, events, spec.event_keys, ts=ts).drop("is_event", "is_event_exact", "is_event_adjacent")
    return df


def _with_lags(df: DataFrame, spec: ModelSpec, ts: str, value: str, past: DataFrame | None = None) -> DataFrame:
    if spec.autoreg:
        df = lags.add_lags(df, value, ts=ts, past=past, **spec.autoreg)
    for col, terms in spec.lagged_regressors.items():
        df = lags.add_lags(df, col, ts=ts, past=past if past is not None and col in past.columns else None, **terms)
    return df


def _design(df: DataFrame, spec: ModelSpec, origin: float, value: str) -> Design:
    columns = {"Intercept": F.lit(1.0)}
    if spec.growth:
        columns[spec.growth] = F.col(spec.growth)
    columns |= changepoint_terms([_decimal(t) - origin for t in spec.changepoints], F.col("ct1"))
    for name, order in spec.seasonality.items():
        c = COMPONENTS[name]
        terms = fourier_terms(c.column, c.period, order, name)
        columns |= terms
        for k, t in enumerate(spec.seasonality_changepoints.get(name, ())):
            # what the season adds from then on
            columns |= {f"{n}_cp{k}": F.when(F.col("ct1") >= _decimal(t) - origin, x).otherwise(F.lit(0.0)) for n, x in terms.items()}
    kept = set(drop_collinear(list(columns))) if spec.algorithm in ("ols", "linear") else set(columns)
    columns = {k: c for k, c in columns.items() if k in kept}
    columns |= {f"events_{k}": (F.col(f"events_{k}") != "").cast("double") for k in spec.event_keys}
    lagged = [(value, spec.autoreg)] if spec.autoreg else []
    for col, terms in [*lagged, *spec.lagged_regressors.items()]:
        names = [f"{col}_lag{k}" for k in terms.get("orders", ())] + [f"{col}_avglag_" + "_".join(map(str, s)) for s in terms.get("sets", ())] + [f"{col}_avglag_{a}_to_{b}" for a, b in terms.get("intervals", ())]
        columns |= {n: F.col(n) for n in names}
    columns |= {r: F.col(r).cast("double") for r in spec.regressors}
    if spec.extra_terms:
        extra = design(df, f"{value} ~ " + " + ".join(spec.extra_terms))
        columns |= {k: c for k, c in extra.columns.items() if k != "Intercept"}
    return Design(value, {k: c for k, c in columns.items() if k not in spec.drop_terms})


def fit_linear(df: DataFrame, spec: ModelSpec, events: DataFrame | None = None, ts: str = TIME, value: str = VALUE, weight: str | None = None) -> LinearModel:
    """Fit one series. Columns but the intercept are scaled to [0, 1] over the training rows before penalties apply."""
    first = df.agg(F.min(ts).alias("t"), F.count("*").alias("n")).first()
    origin = _decimal(first.t)
    ready = _with_lags(_features(df, spec, origin, events, ts), spec, ts, value)
    made = _design(ready, spec, origin, value)
    bounds = ready.agg(*[F.struct(F.min(c), F.max(c)).alias(f"b{k}") for k, c in enumerate(made.columns.values())]).first()
    ranges = {}
    for k, n in enumerate(made.columns):
        low, high = bounds[f"b{k}"]
        low, high = float(low or 0.0), float(high or 0.0)
        ranges[n] = (0.0, 1.0) if n == "Intercept" or high == low else (low, high - low)
    scaled = {n: F.coalesce((c - ranges[n][0]) / ranges[n][1], F.lit(0.0)) if n != "Intercept" else c for n, c in made.columns.items()}
    made = Design(value, scaled)
    known = ready.filter(F.col(value).isNotNull())
    fit = fit_by_name(known, scaled, F.col(value), spec.algorithm, spec.params, F.col(weight) if weight else None, order=F.col(ts))
    g = gram(known, scaled, F.col(value)) if isinstance(fit, Fit) else None
    ci = None
    if spec.uncertainty:
        fitted = predict(known, scaled, fit, FORECAST).withColumn("_res", F.col(value) - F.col(FORECAST))
        u = dict(spec.uncertainty)
        ci = intervals.fit_intervals(fitted, "_res", u.get("quantiles", (0.025, 0.975)), u.get("by", ()), u.get("method", "normal_fit"), u.get("min_rows", 5), u.get("small_quantile", 0.98))
    return LinearModel(spec, origin, made, fit, g, ranges, ci, df, events, first.n)


def fitted_values(model: LinearModel, ts: str = TIME, value: str = VALUE) -> DataFrame:
    ready = _with_lags(_features(model.train, model.spec, model.origin, model.events, ts), model.spec, ts, value)
    return _finish(predict(ready, model.design.columns, model.fit, FORECAST, model.spec.lower, model.spec.upper), model)


def _finish(df: DataFrame, model: LinearModel) -> DataFrame:
    if model.ci is None:
        return df
    scale = prediction_scale(model.design.columns, model.gram, model.fit) if model.gram is not None else None
    return intervals.with_bounds(intervals.apply_intervals(df, model.ci, FORECAST, scale, model.spec.lower, model.spec.upper))


def needs_recursion(model: LinearModel, horizon: int) -> bool:
    """Whether a row of the horizon needs a value that isn't known: the smallest lag is shorter than the horizon."""
    a = model.spec.autoreg
    return bool(a) and lags.lag_span(a.get("orders", ()), a.get("sets", ()), a.get("intervals", ()))[0] < horizon


def predict_linear(model: LinearModel, future: DataFrame, ts: str = TIME, value: str = VALUE, paths: int = 0, seed: int = 1) -> DataFrame:
    """Forecasts of future rows (with their regressors). With lags shorter than the horizon rows follow each other: one noise-free
    path, or the mean and quantiles of ``paths`` noisy ones."""
    n = future.count()
    if not needs_recursion(model, n):
        blank = future if value in future.columns else future.withColumn(value, F.lit(None).cast("double"))
        ready = _with_lags(_features(blank, model.spec, model.origin, model.events, ts), model.spec, ts, value, model.train)
        return _finish(predict(ready, model.design.columns, model.fit, FORECAST, model.spec.lower, model.spec.upper).drop(value), model)
    return simulate(model, future, paths, seed, ts, value)


def simulate(model: LinearModel, future: DataFrame, paths: int = 0, seed: int = 1, ts: str = TIME, value: str = VALUE) -> DataFrame:
    """Recursive forecasts. The part of the prediction that doesn't depend on lags is computed as columns; the recursion adds
    lag terms row by row, per path, over the few latest values of history."""
    spec, a = model.spec, model.spec.autoreg
    beta = model.fit.coefficients()
    lag_names = [f"{value}_lag{k}" for k in a.get("orders", ())]
    set_names = [(f"{value}_avglag_" + "_".join(map(str, s)), list(s)) for s in a.get("sets", ())]
    run_names = [(f"{value}_avglag_{x}_to_{y}", list(range(x, y + 1))) for x, y in a.get("intervals", ())]
    groups = [(n, [int(n.rsplit("lag", 1)[1])]) for n in lag_names] + set_names + run_names
    most = max(k for _, ks in groups for k in ks)
    static = {k: c for k, c in model.design.columns.items() if k not in {n for n, _ in groups}}
    rows = _features(future.withColumn(value, F.lit(None).cast("double")), spec, model.origin, model.events, ts)
    for col, terms in spec.lagged_regressors.items():
        rows = lags.add_lags(rows, col, ts=ts, past=model.train, **terms)
    based = rows.select(ts, sum((F.lit(float(beta.get(k, 0.0))) * c for k, c in static.items()), F.lit(0.0)).alias("_base"))
    past = model.train.filter(F.col(value).isNotNull()).orderBy(F.col(ts).desc()).limit(most).select(ts, F.col(value).alias("_v"))
    history = np.array([r["_v"] for r in past.orderBy(ts).collect()], float)  # as many rows as the largest lag
    noise = 0.0
    if paths and model.ci is not None:
        noise = float(model.ci.fallback.first()["err_std"] or 0.0)
    weights = [(beta.get(n, 0.0), model.ranges[n], ks) for n, ks in groups]
    lo, hi = spec.lower, spec.upper

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        path = int(pdf["_path"].iloc[0])
        rng = np.random.default_rng([seed, path])
        known = list(history)
        out = []
        for base in pdf["_base"]:
            y = base
            for b, (low, width), ks in weights:
                some = [known[-k] for k in ks if k <= len(known)]
                if some and b:
                    y += b * (float(np.mean(some)) - low) / width
            y += rng.normal(0, noise) if noise and path else 0.0
            y = y if lo is None else max(lo, y)
            y = y if hi is None else min(hi, y)
            known.append(y)
            out.append(y)
        return pd.DataFrame({ts: pdf[ts], "_path": path, FORECAST: out})

    each = based.withColumn("_path", F.explode(F.sequence(F.lit(1 if paths else 0), F.lit(paths))))
    simulated = each.groupBy("_path").applyInPandas(run, f"{ts} timestamp_ntz, _path int, {FORECAST} double")
    if not paths:
        out = future.join(simulated.drop("_path"), ts)
        if model.ci is None:
            return out
        # the residuals' own width: rows that depend on forecasts have no design row to scale it by
        return intervals.with_bounds(intervals.apply_intervals(_features(out, spec, model.origin, None, ts), model.ci, FORECAST, None, lo, hi))
    quantiles = (model.ci.quantiles if model.ci else None) or [0.025, 0.975]
    stats = simulated.groupBy(ts).agg(F.avg(FORECAST).alias(FORECAST), F.percentile(FORECAST, F.array(*[F.lit(q) for q in quantiles])).alias("quantile_summary"), F.stddev_samp(simulated[FORECAST]).alias("err_std"))
    return intervals.with_bounds(future.join(stats, ts))


def component_breakdown(model: LinearModel, df: DataFrame, groups: dict[str, str] | None = None, ts: str = TIME, value: str = VALUE, **how) -> DataFrame:
    """Trend, seasonality, events, autoregression and the rest, which add up to the forecast."""
    from tidewater.schema import EVENT_REGEX, LAG_REGEX, SEASONALITY_REGEX, TREND_REGEX

    groups = groups or {"autoreg": f".*(?:{LAG_REGEX})", "events": f".*{EVENT_REGEX}", "seasonality": f".*(?:{SEASONALITY_REGEX})", "trend": f".*(?:{TREND_REGEX})"}
    ready = _with_lags(_features(df, model.spec, model.origin, model.events, ts), model.spec, ts, value)
    return breakdown(ready, model.design.columns, model.fit, groups, **how)


def future_rows(spark: SparkSession, model: LinearModel, horizon: int, ts: str = TIME) -> DataFrame:
    last = model.train.agg(F.max(ts).alias("t"))
    step = F.expr(f"interval {model.spec.interval}")
    return last.select(F.explode(F.sequence(F.col("t") + step, F.col("t") + step * horizon, step)).alias(ts))


def fit_many(df: DataFrame, columns: dict, response: str, keys: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """(keys, term, estimate): ridge coefficients of every series at once; each series is one small matrix in one task."""
    from tidewater.operators.regression import fit_ridge, gram_from, gram_table

    names = list(columns)
    sums = gram_table(df, list(columns.values()), F.col(response), None, keys)

    def solve(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                beta = fit_ridge(gram_from(r.sums, names), alpha).beta
                yield pd.DataFrame({**{k: [getattr(r, k)] * len(names) for k in keys}, "term": names, "estimate": beta})

    kinds = dict(df.dtypes)
    return sums.mapInPandas(solve, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "term string", "estimate double"]))
