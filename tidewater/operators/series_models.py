"""Regression forecasters of many series in one job: any specification, one model for each combination of keys.

The design of all series is computed once and written as a table of arrays. A pass over it adds up one matrix per series
and partition, so that a series with a third of all rows is as spread as the others; what meets in one task are these
matrices, never rows. Columns are scaled to [0, 1] per series on the matrix itself: with sums of the raw columns, of where
they are known, and their smallest and largest values, no second pass is needed. Models are rows of a table (series,
origin, ranges, coefficients), which the rows to predict join.

Rows to predict may lie before, inside or after the training rows of their series, with gaps: see ``predict_series``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.calendar import add_time_features, continuous_year
from tidewater.operators import intervals, lags, linear_model
from tidewater.operators.linear_model import ModelSpec
from tidewater.operators.regression import Design, Fit, Gram, _penalty, fit_adaptive_lasso, fit_elastic_net, fit_lasso, fit_lasso_cv, fit_ols, fit_ridge, fit_ridge_cv
from tidewater.schema import ERR_STD, EVENT_REGEX, FORECAST, LAG_REGEX, QUANTILES, SEASONALITY_REGEX, TIME, TREND_REGEX, VALUE, split_by_patterns
from tidewater.staging import staged, unstage

_ORIGIN, _FIRST, _LAST, _KNOWN = "_origin", "_first", "_last", "_known"
#: Parts of the training time that penalties are chosen on.
FOLDS = 5
_OLS = ("ols", "linear", "statsmodels_ols", "wls", "statsmodels_wls")
#: Algorithms that are fitted from sums of products.
ALGORITHMS = (*_OLS, "ridge", "lasso", "lasso_lars", "lars", "elastic_net", "sgd", "adaptive_lasso")


@dataclass
class SeriesModels:
    """Fitted models, one row each in ``table``: keys, span of training, origin, terms (low, slope), coefficients, roots."""

    spec: ModelSpec
    keys: list[str]
    columns: dict[str, Column]
    table: DataFrame
    train: DataFrame
    events: DataFrame | None = None
    slices: DataFrame | None = None
    fallback: DataFrame | None = None
    staged: list[DataFrame] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return list(self.columns)

    @property
    def design(self) -> Design:
        """The columns before scaling."""
        return Design(VALUE, self.columns)

    @property
    def ci(self) -> intervals.IntervalModel | None:
        """The residual distributions, where the models have them."""
        u = self.spec.uncertainty or {}
        return None if self.fallback is None else intervals.IntervalModel(self.slices, self.fallback, list(u.get("by", ())), list(u.get("quantiles", (0.025, 0.975))))

    def coefficients(self) -> DataFrame:
        """(keys, term, estimate): coefficients of the scaled columns."""
        named = F.arrays_zip(F.array(*[F.lit(n) for n in self.names]).alias("term"), F.col("beta").alias("estimate"))
        return self.table.select(*self.keys, F.explode(named).alias("_t")).select(*self.keys, "_t.term", "_t.estimate")

    def free(self) -> None:
        """Delete the models' tables; nothing can be predicted then."""
        unstage(*self.staged)


def _meet(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by series; without keys ``other`` is one row."""
    return df.join(other, list(keys), how) if keys else df.crossJoin(F.broadcast(other))


def _events_of(df: DataFrame, events: DataFrame | None, spec: ModelSpec, ts: str) -> DataFrame:
    """Adds the keys of a day's events as an array, by one join whatever the number of keys."""
    if events is None or not spec.event_keys:
        return df.withColumn("_events", F.lit(None).cast("array<string>"))
    days = events.filter(F.col("event_key").isin(list(spec.event_keys))).groupBy(F.col("date").alias("_date")).agg(F.collect_set("event_key").alias("_events"))
    return df.withColumn("_date", F.to_date(ts)).join(days, "_date", "left").drop("_date")


def _lagged(df: DataFrame, spec: ModelSpec, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    for col, terms in ([(value, spec.autoreg)] if spec.autoreg else []) + list(spec.lagged_regressors.items()):
        df = lags.add_lags(df, col, keys=keys, ts=ts, **terms)
    return df


def lag_names(spec: ModelSpec, value: str = VALUE) -> list[tuple[str, list[int]]]:
    """Names of the autoregressive columns, and the lags that each is the mean of."""
    a = spec.autoreg or {}
    return (
        [(f"{value}_lag{k}", [k]) for k in a.get("orders", ())]
        + [(f"{value}_avglag_" + "_".join(map(str, s)), list(s)) for s in a.get("sets", ())]
        + [(f"{value}_avglag_{x}_to_{y}", list(range(x, y + 1))) for x, y in a.get("intervals", ())]
    )


def calendar_of(spec: ModelSpec) -> list[str]:
    """The calendar features that the specification's terms are made of."""
    terms = " ".join(spec.extra_terms)
    seasons = [linear_model.COMPONENTS[c].column for c in spec.seasonality]
    trends = [spec.growth] if spec.growth else []
    return [c for c in linear_model._CALENDAR if c in (*seasons, *trends, *(["ct1"] if spec.changepoints or spec.seasonality_changepoints else [])) or re.search(rf"\b{c}\b", terms)]


def _columns(df: DataFrame, spec: ModelSpec, value: str) -> dict[str, Column]:
    """The design, by name: the same terms as of a single series, with events from the array of the day."""
    made = linear_model._design(df, spec, F.col(_ORIGIN), value).columns
    for k in spec.event_keys:
        if f"events_{k}" in made:
            made[f"events_{k}"] = F.coalesce(F.array_contains("_events", k), F.lit(False)).cast("double")
    return made


def fit_gram(g: Gram, spec: ModelSpec, folds: Sequence[Gram] = ()) -> Fit:
    """One small fit on sums of products, by the algorithm's name; ridge and lasso without a penalty choose it on ``folds``."""
    params = dict(spec.params)
    if spec.algorithm in _OLS:
        return fit_ols(g)
    if spec.algorithm == "ridge":
        return fit_ridge(g, params["alpha"]) if params.get("alpha") is not None else fit_ridge_cv(g, folds, params.get("alphas"))
    if spec.algorithm in ("lasso", "lasso_lars", "lars"):
        return fit_lasso(g, params["alpha"]) if params.get("alpha") is not None else fit_lasso_cv(g, folds)
    if spec.algorithm in ("elastic_net", "sgd"):
        return fit_elastic_net(g, params.get("alpha", 1.0), params.get("l1_ratio", 0.5))
    if spec.algorithm == "adaptive_lasso":
        return fit_adaptive_lasso(g, strength=params.get("strength", 0.5))
    raise ValueError(f"{spec.algorithm} isn't fitted from sums of products; use linear_model.fit_linear for one series")


def nullable(names: Sequence[str], spec: ModelSpec) -> list[int]:
    """Columns that may be null: lags, regressors and terms of formulas."""
    sure = ("Intercept", "ct", "changepoint", "sin", "cos", "events_")
    return [k for k, n in enumerate(names) if not n.startswith(sure) or ":" in n or n in spec.regressors or n.split("_lag")[0] in spec.lagged_regressors]


def sums_table(design: DataFrame, groups: Sequence[str], p: int, unsure: Sequence[int], weight: str | None = None, value: str = VALUE) -> DataFrame:
    """(groups, sums, low, high, n): matrices of each group and partition, of rows with a value; ranges are those of all rows."""
    unsure, groups = list(unsure), list(groups)
    size = p + len(unsure) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}

        def out():
            cols = [pa.array([k[i] for k in found], schema.field(g).type) for i, g in enumerate(groups)]
            values = list(found.values())
            lists = [pa.array([list(x) for x in part], pa.list_(pa.float64())) for part in ([v[0].ravel() for v in values], [v[1] for v in values], [v[2] for v in values])]
            return pa.RecordBatch.from_arrays([*cols, *lists, pa.array([v[3] for v in values], pa.int64())], [*groups, "sums", "low", "high", "n"])

        schema = None
        for batch in batches:
            schema = batch.schema
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)
            y = batch.column(value).to_numpy(zero_copy_only=False).astype(float)
            w = np.ones(len(y)) if weight is None else batch.column(weight).to_numpy(zero_copy_only=False).astype(float)
            if groups:
                frame = batch.select(groups).to_pandas()
                runs = list(frame.groupby(groups, dropna=False, sort=False).indices.values())
                named = [tuple(batch.column(g)[int(i[0])].as_py() for g in groups) for i in runs]
            else:
                runs, named = [np.arange(len(y))], [()]
            for k, rows in zip(named, runs, strict=True):
                own, known = x[rows], ~np.isnan(y[rows]) & ~np.isnan(w[rows])
                with np.errstate(all="ignore"):
                    low, high = np.fmin.reduce(own, axis=0, initial=np.inf), np.fmax.reduce(own, axis=0, initial=-np.inf)
                v = np.concatenate([np.nan_to_num(own), ~np.isnan(own[:, unsure]), y[rows][:, None]], axis=1)[known]
                s = (v * w[rows][known][:, None]).T @ v
                if (have := found.get(k)) is None:
                    found[k] = [s, low, high, int(known.sum())]
                else:
                    have[0] += s
                    have[1], have[2] = np.minimum(have[1], low), np.maximum(have[2], high)
                    have[3] += int(known.sum())
            if len(found) * size * size > 4_000_000:  # 32 MB of matrices at most wait
                yield out()
                found.clear()
        if found:
            yield out()

    kinds = {f.name: f.dataType for f in design.schema}
    schema = T.StructType([T.StructField(g, kinds[g]) for g in groups] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("sums", "low", "high")] + [T.StructField("n", T.LongType())])
    return design.select(*groups, "x", value, *([weight] if weight else [])).mapInArrow(add, schema)


class Sums:
    """Added sums of one series: ranges, and the matrix of the scaled columns."""

    def __init__(self, sums: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, names: Sequence[str], unsure: Sequence[int]):
        self.sums, self.low, self.high, self.n, self.names, self.unsure = sums, low, high, n, list(names), list(unsure)

    @classmethod
    def of(cls, rows: pd.DataFrame, names: Sequence[str], unsure: Sequence[int]) -> Sums:
        size = len(names) + len(unsure) + 1
        add = reduce(np.add, (np.asarray(s, float) for s in rows["sums"]))
        low, high = reduce(np.minimum, (np.asarray(s, float) for s in rows["low"])), reduce(np.maximum, (np.asarray(s, float) for s in rows["high"]))
        return cls(add.reshape(size, size), low, high, int(rows["n"].sum()), names, unsure)

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Low and width of each column; 0 and 1 for the intercept and for columns of one value or none."""
        low, width = self.low.copy(), self.high - self.low
        flat = ~np.isfinite(width) | (width <= 0)
        flat[[k for k, n in enumerate(self.names) if n == "Intercept"]] = True
        low[flat], width[flat] = 0.0, 1.0
        return low, width

    def scaled(self, low: np.ndarray, width: np.ndarray) -> Gram:
        p, i = len(self.names), self.names.index("Intercept")
        a = np.zeros((p + 1, len(self.sums)))
        for k in range(p):
            a[k, k] = 1 / width[k]
            if low[k]:
                # where the column is known its range starts at 0; where it isn't it counts as 0
                a[k, p + self.unsure.index(k) if k in self.unsure else i] -= low[k] / width[k]
        a[p, -1] = 1.0
        m = a @ self.sums @ a.T
        return Gram(self.names, m[:p, :p], m[:p, p], float(m[p, p]), float(m[i, i]), self.n)


def _roots(g: Gram, fit: Fit) -> np.ndarray:
    """R with R'R = H of a new row's variance x'Hx."""
    a = np.linalg.pinv(g.xx + _penalty(g.names, fit.alpha), hermitian=True)
    h = a @ g.xx @ a
    size, vectors = np.linalg.eigh((h + h.T) / 2)
    keep = size > max(size.max(initial=0.0), 0.0) * 1e-15
    return (vectors[:, keep] * np.sqrt(size[keep])).T


def term_sum(x: str = "x", terms: str = "terms") -> Column:
    """Sum of slope times (column less low); a null column counts as 0."""
    parts = F.zip_with(F.col(x), F.col(terms), lambda v, t: F.coalesce((v - t["low"]) * t["slope"], F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def scale_of(x: str = "x", terms: str = "terms", roots: str = "roots") -> Column:
    """sqrt(1 + x'Hx) of the scaled row."""
    v = F.zip_with(F.col(x), F.col(terms), lambda c, t: F.coalesce((c - t["low"]) / t["width"], F.lit(0.0)))
    dot = lambda r: F.aggregate(F.zip_with(r, v, lambda p, q: p * q), F.lit(0.0), lambda a, b: a + b)
    squares = F.transform(F.col(roots), lambda r: F.pow(dot(r), F.lit(2.0)))
    return F.sqrt(1 + F.aggregate(squares, F.lit(0.0), lambda a, b: a + b))


def design_table(df: DataFrame, spec: ModelSpec, origins: DataFrame, keys: Sequence[str], events: DataFrame | None, ts: str, value: str, more: Sequence[str] = (), columns: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """(keys, ts, y, more, x) of every row, and the columns that x holds in order. Origins are (keys, _origin, _first, _last)."""
    placed = _events_of(_meet(df, origins, keys), events, spec, ts)
    wanted = [c for c in dict.fromkeys([*calendar_of(spec), *more]) if c not in df.columns]
    timed = add_time_features(placed, wanted, ts, F.col(_ORIGIN)) if wanted else placed
    ready = _lagged(timed, spec, keys, ts, value)
    columns = columns or _columns(ready, spec, value)
    x = F.array(*[c.cast("double") for c in columns.values()]).alias("x")
    return ready.select(*keys, ts, F.col(value).cast("double").alias(value), *[c for c in more if c not in (*keys, ts, value)], _FIRST, _LAST, x), columns


def keyed_intervals(df: DataFrame, residual: str, keys: Sequence[str], quantiles: Sequence[float], by: Sequence[str] = (), method: str = "normal_fit", min_rows: int = 5, small_quantile: float = 0.98) -> tuple[DataFrame | None, DataFrame]:
    """Residual distributions per series and slice (keys, by, qs, err_std), and the row of each series that small slices fall back to.

    The rule is that of ``intervals.fit_intervals``, within each series.
    """
    from tidewater.operators.intervals import normal_quantiles

    def shaped(by: Sequence[str]) -> DataFrame:
        known = df.filter(F.col(residual).isNotNull())
        aggs = [F.count("*").alias("_n"), F.stddev_samp(residual).alias(ERR_STD)]
        if method != "normal_fit":
            aggs += [F.avg(residual).alias("_mean"), F.percentile(residual, F.array(*[F.lit(q) for q in quantiles])).alias("_q")]
        stats = known.groupBy(*by).agg(*aggs)
        qs = normal_quantiles(F.col(ERR_STD), quantiles) if method == "normal_fit" else F.transform("_q", lambda q: q - F.col("_mean"))
        return stats.withColumn("qs", qs)

    overall = shaped(keys).select(*keys, "qs", ERR_STD)
    if not by:
        return None, overall
    large = shaped([*keys, *by]).filter((F.col("_n") >= min_rows) & F.col(ERR_STD).isNotNull())
    own = Window.partitionBy(*keys)
    place = F.row_number().over(own.orderBy(ERR_STD, *by)) / F.count("*").over(own)
    near = large.withColumn("_d", F.abs(place - small_quantile))
    near = near.withColumn("_k", F.row_number().over(own.orderBy("_d", *by))).filter("_k = 1").select(*keys, F.col("qs").alias("_nq"), F.col(ERR_STD).alias("_ns"))
    joined = overall.join(near, list(keys), "left") if keys else overall.join(near, F.lit(True), "left")
    fallback = joined.select(*keys, F.coalesce("_nq", "qs").alias("qs"), F.coalesce("_ns", ERR_STD).alias(ERR_STD))
    return large.select(*keys, *by, "qs", ERR_STD), fallback


def fit_series(df: DataFrame, spec: ModelSpec, keys: Sequence[str] = (), events: DataFrame | None = None, ts: str = TIME, value: str = VALUE, weight: str | None = None) -> SeriesModels:
    """One model for each series of ``df`` (one row per series and time), in a number of jobs that doesn't depend on the series.

    Series without any value, and rows with a null key, have no model. Changepoints of the specification are times, shared by all series.
    """
    keys = list(keys)
    used = [*keys, ts, value, *dict.fromkeys([*spec.regressors, *spec.lagged_regressors, *([weight] if weight else [])])]
    span = df.groupBy(*keys).agg(F.min(ts).alias(_FIRST), F.max(ts).alias(_LAST), F.max(F.when(F.col(value).isNotNull(), F.col(ts))).alias(_KNOWN))
    origins = span.withColumn(_ORIGIN, continuous_year(F.col(_FIRST)))
    u = dict(spec.uncertainty or {})
    by = list(u.get("by", ()))
    made, columns = design_table(df.select(*used), spec, origins, keys, events, ts, value, [*by, *([weight] if weight else [])])
    design = staged(made, "design")
    names, unsure = list(columns), nullable(list(columns), spec)
    folded = spec.algorithm in ("ridge", "lasso", "lasso_lars", "lars") and spec.params.get("alpha") is None
    if folded:
        # contiguous parts of each series' own time
        share = (F.unix_timestamp(ts) - F.unix_timestamp(_FIRST)) / F.greatest(F.unix_timestamp(_LAST) - F.unix_timestamp(_FIRST), F.lit(1))
        parts = sums_table(design.withColumn("_fold", F.least(F.floor(share * FOLDS), F.lit(FOLDS - 1)).cast("int")), [*keys, "_fold"], len(names), unsure, weight, value)
    else:
        parts = sums_table(design, keys, len(names), unsure, weight, value)
    wants_scale = bool(spec.uncertainty)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        total = Sums.of(rows, names, unsure)
        if not total.n:
            return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "terms": [], "beta": [], "roots": [], "alpha": 0.0, "n": 0}])
        low, width = total.ranges()
        g = total.scaled(low, width)
        folds = [Sums.of(part, names, unsure).scaled(low, width) for _, part in rows.groupby("_fold")] if folded else ()
        fit = fit_gram(g, spec, [f for f in folds if f.rows])
        terms = [{"low": a, "width": b, "slope": c / b} for a, b, c in zip(low.tolist(), width.tolist(), fit.beta.tolist(), strict=True)]
        roots = _roots(g, fit).tolist() if wants_scale else []
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "terms": terms, "beta": fit.beta.tolist(), "roots": roots, "alpha": float(fit.alpha), "n": total.n}])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "terms array<struct<low: double, width: double, slope: double>>, beta array<double>, roots array<array<double>>, alpha double, n long"])
    solved = parts.groupBy(*keys).applyInPandas(solve, shape) if keys else parts.groupBy(F.lit(0).alias("_one")).applyInPandas(solve, shape)
    table = staged(_meet(solved.filter("n > 0"), origins, keys), "models")
    models = SeriesModels(spec, keys, columns, table, df.select(*used), events, staged=[design, table])
    if spec.uncertainty:
        fitted = _meet(design, table.select(*keys, "terms"), keys).withColumn("_res", F.col(value) - _clipped(term_sum(), spec))
        slices, fallback = keyed_intervals(fitted, "_res", keys, u.get("quantiles", (0.025, 0.975)), by, u.get("method", "normal_fit"), u.get("min_rows", 5), u.get("small_quantile", 0.98))
        models.slices, models.fallback = (None if slices is None else staged(slices, "slices")), staged(fallback, "fallback")
        models.staged += [t for t in (models.slices, models.fallback) if t is not None]
    return models


def _clipped(c: Column, spec: ModelSpec) -> Column:
    c = c if spec.lower is None else F.greatest(c, F.lit(float(spec.lower)))
    return c if spec.upper is None else F.least(c, F.lit(float(spec.upper)))


def fitted_series(models: SeriesModels, ts: str = TIME, value: str = VALUE) -> DataFrame:
    """(keys, ts, y, forecast) of the training rows, from the design that was written for the fit."""
    rows = _meet(models.staged[0], models.table.select(*models.keys, "terms"), models.keys)
    return rows.select(*models.keys, ts, value, _clipped(term_sum(), models.spec).alias(FORECAST))


def part_sum(at: Sequence[int], x: str = "x", terms: str = "terms") -> Column:
    """Sum of slope times column over some of the columns, a null one as its lowest value."""
    one = lambda i: F.coalesce(F.col(x)[i], F.col(terms)[i]["low"]) * F.col(terms)[i]["slope"]
    return F.aggregate(F.transform(F.array(*[F.lit(i) for i in at]), one), F.lit(0.0), lambda a, b: a + b) if at else F.lit(0.0)


def fitted_components(models: SeriesModels, groups: dict[str, str] | None = None, remainder: str = "OTHER", ts: str = TIME, value: str = VALUE) -> DataFrame:
    """(keys, ts, y, Intercept, one column per group, the rest, forecast) of the training rows; parts add up to the forecast.

    Groups are patterns of the start of a term's name, the first that matches has it; by default autoregression, events,
    seasonality and trend. Without limits on the forecast, that is: a limited one is below or above the sum.
    """
    groups = groups or {"autoreg": f".*(?:{LAG_REGEX})", "events": f".*{EVENT_REGEX}", "seasonality": f".*(?:{SEASONALITY_REGEX})", "trend": f".*(?:{TREND_REGEX})"}
    named, rest = split_by_patterns([n for n in models.names if n != "Intercept"], groups)
    parts = {"Intercept": ["Intercept"]} | named | {remainder: rest}
    rows = _meet(models.staged[0], models.table.select(*models.keys, "terms"), models.keys)
    # columns are scaled from their lowest values: what that takes off is the intercept's
    shift = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["low"] * t["slope"])
    sums = [(part_sum([models.names.index(n) for n in ns]) - (shift if g == "Intercept" else 0.0)).alias(g) for g, ns in parts.items()]
    return rows.select(*models.keys, ts, value, *sums, _clipped(term_sum(), models.spec).alias(FORECAST))


def _with_intervals(df: DataFrame, models: SeriesModels, scale: Column | None) -> DataFrame:
    if models.fallback is None:
        return df
    spec, by = models.spec, list((models.spec.uncertainty or {}).get("by", ()))
    out = _meet(df, models.fallback.select(*models.keys, F.col("qs").alias("_fq"), F.col(ERR_STD).alias("_fs")), models.keys, "left")
    if models.slices is not None:
        out = out.join(models.slices.select(*models.keys, *by, F.col("qs").alias("_q"), F.col(ERR_STD).alias("_s")), [*models.keys, *by], "left")
    else:
        out = out.withColumns({"_q": F.col("_fq"), "_s": F.col("_fs")})
    times = F.lit(1.0) if scale is None else scale
    qs = intervals.offset_array(F.transform(F.coalesce("_q", "_fq"), lambda q: q * times), F.col(FORECAST))
    out = out.withColumns({QUANTILES: intervals.clip_array(qs, spec.lower, spec.upper), ERR_STD: F.coalesce("_s", "_fs") * times})
    return intervals.with_bounds(out).drop("_q", "_s", "_fq", "_fs")


def future_of(models: SeriesModels, horizon: int, ts: str = TIME) -> DataFrame:
    """(keys, ts): the next ``horizon`` times of every series."""
    step = F.expr(f"interval {models.spec.interval}")
    return models.table.select(*models.keys, F.explode(F.sequence(F.col(_LAST) + step, F.col(_LAST) + step * horizon, step)).alias(ts))


def least_seconds(interval: str) -> int:
    """Seconds of an interval of one number and unit; months and years at their shortest."""
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 28 * 86400, "year": 365 * 86400}[unit.rstrip("s")]


def predict_series(models: SeriesModels, rows: DataFrame, ts: str = TIME, value: str = VALUE) -> DataFrame:
    """The rows with part (before, inside, after), forecast and, where the models have them, interval columns.

    * inside: the fitted value of that training time; a time between two training times takes the lags of the later one.
    * after: lags come from the training rows and, where they reach past these, from forecasts made on the way. Times that
      are missing between training and the first row asked for are gone through and left out again; so are those between
      rows asked for. Their regressors are those of the latest row before.
    * before: every lag is the first known training value.

    Rows that repeat a time get the same forecast, with the regressors of one of them. Rows of unknown series, of null keys
    or times stay with null.
    """
    spec, keys = models.spec, models.keys
    regressors = list(dict.fromkeys([*spec.regressors, *spec.lagged_regressors]))
    by = [c for c in (spec.uncertainty or {}).get("by", ())]
    results = ("part", FORECAST, QUANTILES, ERR_STD, "forecast_lower", "forecast_upper")
    rows = rows.drop(*[c for c in results if c not in keys])
    ends = models.table.select(*keys, _ORIGIN, _FIRST, _LAST, _KNOWN)
    asked = rows.filter(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count("*").alias("_asked"), *[F.first(r, ignorenulls=True).alias(r) for r in regressors])
    t = F.col(ts)
    part = F.when(t < F.col(_FIRST), "before").when(t <= F.col(_LAST), "inside").otherwise("after")
    placed = _meet(asked, ends, keys).withColumn("part", part).drop(_ORIGIN)
    # one small job tells which parts there are, and how far the longest series has to go
    on = models.train.select(*keys, ts, F.lit(True).alias("_on"))
    marked = placed.join(on, [*keys, ts], "left")
    steps = F.ceil((F.unix_timestamp(t.cast("timestamp")) - F.unix_timestamp(F.col(_LAST).cast("timestamp"))) / least_seconds(spec.interval))
    count = lambda c: F.count_if(c).alias
    is_part = {p: F.col("part") == p for p in ("before", "inside", "after")}
    there = marked.agg(count(is_part["before"])("before"), count(is_part["inside"] & F.col("_on"))("inside"), count(is_part["inside"] & F.col("_on").isNull())("between"), F.max(F.when(is_part["after"], steps)).alias("steps")).first()
    shortest, longest = lags.lag_span(*[(spec.autoreg or {}).get(k, ()) for k in ("orders", "sets", "intervals")])
    recursive = bool(spec.autoreg) and shortest < (there.steps or 0)
    terms = models.table.select(*keys, "terms", "roots")

    def designed(df: DataFrame, lagged: bool = True) -> DataFrame:
        own = spec if lagged else replace(spec, autoreg=None, lagged_regressors={})
        return design_table(df, own, ends, keys, models.events, ts, value, ["_asked", "part", *by], models.columns)[0]

    pieces: list[DataFrame] = []
    design = models.staged[0]
    if there.inside:
        pieces.append(design.join(placed.filter(is_part["inside"]).select(*keys, ts), [*keys, ts]).withColumn("part", F.lit("inside")))
    if there.between:
        missing = marked.filter(is_part["inside"] & F.col("_on").isNull()).select(*keys, ts)
        pieces.append(_between(models, missing, ts, value, by, ends))
    if there.steps:
        after = placed.filter(is_part["after"]).drop(_FIRST, _LAST, _KNOWN)
        every = after.withColumn(value, F.lit(None).cast("double"))
        if spec.autoreg or spec.lagged_regressors:
            # the grid from the end of training to the last time asked for, and the training rows that its lags reach
            step = F.expr(f"interval {spec.interval}")
            reach = placed.filter(is_part["after"]).groupBy(*keys).agg(F.max(ts).alias("_to"), F.first(_LAST).alias("_from")).filter(F.col("_from") + step <= F.col("_to"))
            grid = reach.select(*keys, F.explode(F.sequence(F.col("_from") + step, F.col("_to"), step)).alias(ts)).join(after.select(*keys, ts), [*keys, ts], "left_anti")
            on_way = grid.withColumns({"_asked": F.lit(0).cast("long"), "part": F.lit("gap")})
            every = _recent(models, longest, ts).withColumns({"_asked": F.lit(0).cast("long"), "part": F.lit("train")}).unionByName(after, allowMissingColumns=True).unionByName(on_way, allowMissingColumns=True)
            w = Window.partitionBy(*keys).orderBy(ts)
            every = every.withColumns({r: F.when(F.col("part") == "gap", F.last(r, ignorenulls=True).over(w)).otherwise(F.col(r)) for r in regressors}) if regressors else every
        forward = designed(every)
        if not recursive:
            pieces.append(forward.filter(F.col("part") == "after"))
    if there.before:
        lagged = [(value, spec.autoreg)] * bool(spec.autoreg) + list(spec.lagged_regressors.items())
        starts = models.train.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).cast("double").alias(f"_start_{c}") for c, _ in lagged], F.lit(0).alias("_start"))
        earlier = _meet(placed.filter(is_part["before"]).drop(_FIRST, _LAST, _KNOWN).withColumn(value, F.lit(None).cast("double")), starts, keys)
        earlier = earlier.withColumns({n: F.col(f"_start_{c}") for c, terms_ in lagged for n, _ in lag_names(replace(spec, autoreg=terms_), c)}) if lagged else earlier
        pieces.append(designed(earlier, False))
    if not pieces:
        pieces.append(design.withColumn("part", F.lit("inside")).filter(F.lit(False)))
    pieces = [p.select(*keys, ts, "part", *by, "x") for p in pieces]
    straight = _meet(reduce(DataFrame.unionByName, pieces), terms, keys)
    straight = _with_intervals(straight.withColumn(FORECAST, _clipped(term_sum(), spec)), models, scale_of() if models.fallback is not None else None)
    out = straight.drop("x", "terms", "roots")
    if recursive:
        base = _meet(forward.filter(F.col("part").isin("after", "gap")), terms, keys)
        out = out.unionByName(_with_intervals(_recursed(models, base, longest, ts, value, by), models, None))
    answers = out.drop(*by)
    return rows.join(answers, [*keys, ts], "left")


def _recent(models: SeriesModels, longest: int, ts: str) -> DataFrame:
    """Training rows that lags of later rows can see, and the latest known value before them; all of them where regressors lag."""
    if models.spec.lagged_regressors:
        return models.train
    n, unit = models.spec.interval.split()
    start = F.least(F.col(_KNOWN), F.col(_LAST) - F.expr(f"interval {int(n) * longest} {unit}"))
    return _meet(models.train, models.table.select(*models.keys, start.alias("_start")), models.keys).filter(F.col(ts) >= F.col("_start")).drop("_start")


def _between(models: SeriesModels, missing: DataFrame, ts: str, value: str, by: Sequence[str], ends: DataFrame) -> DataFrame:
    """Design of times between training times: calendar and events of the time, lags and regressors of the next training time."""
    keys, names, spec = models.keys, models.names, models.spec
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(0, Window.unboundedFollowing)
    own = models.staged[0].select(*keys, ts, F.col("x").alias("_next"))
    both = own.unionByName(missing.withColumn("_next", F.lit(None).cast("array<double>")))
    found = both.withColumns({"_n": F.first("_next", ignorenulls=True).over(w), "_mine": F.col("_next").isNull()}).filter("_mine").select(*keys, ts, "_n")
    moving = [k for k in nullable(names, spec) if ":" not in names[k] and "[" not in names[k]]
    blank = {names[k]: F.lit(None).cast("double") for k in moving} | {value: F.lit(None).cast("double"), "part": F.lit("inside")}
    made = design_table(missing.withColumns(blank), replace(spec, autoreg=None, lagged_regressors={}), ends, keys, models.events, ts, value, ["part", *by], models.columns)[0]
    x = F.array(*[F.col("_n")[k] if k in moving else F.col("x")[k] for k in range(len(names))])
    return made.join(found, [*keys, ts]).withColumn("x", x).drop("_n")


def _recursed(models: SeriesModels, base: DataFrame, longest: int, ts: str, value: str, by: Sequence[str]) -> DataFrame:
    """Rows after training one after another: the part without lags is a column, lag terms are added in order of time.

    A task holds a series' rows after training and as many training values as the longest lag.
    """
    spec, keys, names = models.spec, models.keys, models.names
    lagged = lag_names(spec, value)
    at = {n: names.index(n) for n, _ in lagged if n in names}
    x = F.array(*[F.lit(None).cast("double") if k in at.values() else F.col("x")[k] for k in range(len(names))])
    slopes = F.array(*[F.col("terms")[k] for k in at.values()]).alias("_slopes")
    rows = base.withColumn("x", x).select(*keys, ts, "part", *by, term_sum().alias("_base"), slopes)
    w = Window.partitionBy(*keys)
    filled = _recent(models, longest, ts).withColumn("_v", lags.fill_both_ways(value, keys, ts))
    history = filled.withColumn("_r", F.row_number().over(w.orderBy(F.col(ts).desc()))).filter(F.col("_r") <= longest)
    # names of its own: both sides come from the training rows
    history = history.select(*[F.col(k).alias(f"_past{i}") for i, k in enumerate(keys)], F.col(ts).alias("_t"), "_v")
    groups = [ks for n, ks in lagged if n in at]
    lower, upper = spec.lower, spec.upper

    def run(rows: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ts)
        known = past.sort_values("_t")["_v"].tolist()
        out = []
        for start, own in zip(rows["_base"], rows["_slopes"], strict=True):
            y = start
            for ks, s in zip(groups, own, strict=True):
                some = [known[-k] for k in ks if k <= len(known) and known[-k] is not None and not np.isnan(known[-k])]
                if some:
                    y += s["slope"] * (float(np.mean(some)) - s["low"])
            y = y if lower is None else max(lower, y)
            y = y if upper is None else min(upper, y)
            known.append(y)
            out.append(y)
        return rows.assign(**{FORECAST: out})[[*keys, ts, "part", *by, FORECAST]]

    shape = T.StructType([f for f in rows.schema if f.name not in ("_base", "_slopes")] + [T.StructField(FORECAST, T.DoubleType())])
    if keys:
        made = rows.groupBy(*keys).cogroup(history.groupBy(*[f"_past{i}" for i in range(len(keys))])).applyInPandas(run, shape)
    else:
        one = lambda d: d.withColumn("_one", F.lit(0)).groupBy("_one")
        made = one(rows).cogroup(one(history)).applyInPandas(run, shape)
    return made.filter("part = 'after'")
