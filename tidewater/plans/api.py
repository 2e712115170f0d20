"""Entry points: a forecaster and a detector over Spark DataFrames, run from a configuration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import metrics
from tidewater.operators import changepoints, clean, detect, events, evaluation, labels, lags, linear_model, rolling_search, seasonality, series_models, timegrid
from tidewater.plans import templates
from tidewater.plans.config import DetectionConfig, ForecastConfig
from tidewater.schema import ACTUAL, FORECAST, TIME, VALUE, finite, simple_frequency
from tidewater.staging import staged, unstage

_UNITS = {"S": (1, "second"), "min": (1, "minute"), "H": (1, "hour"), "h": (1, "hour"), "D": (1, "day"), "W": (7, "day"), "M": (1, "month"), "MS": (1, "month"), "ME": (1, "month"), "QS": (3, "month"), "QE": (3, "month"), "YS": (1, "year"), "YE": (1, "year")}
#: Metrics of which more is better; of all others less is.
_MORE_IS_BETTER = {"CORR", "R2", "R2_null_model_score", "PREDICTION_BAND_COVERAGE"}
#: Names of growth terms.
_GROWTH = {"linear": "ct1", "quadratic": "ct2", "cubic": "ct3", "sqrt": "ct_sqrt", "cuberoot": "ct_root3", None: ""}
_HOLIDAYS = ["Christmas Day", "New Year's Day", "Thanksgiving", "Independence Day", "Labor Day"]


def interval_of(freq: str | None) -> str:
    """The interval of a frequency name: a number, a unit, and for weeks the day that they end with (5min, 2H, W-SUN, ME)."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-[A-Z]{3})?", freq or "")
    if not m or m[2] not in _UNITS:
        raise ValueError(f"a regular frequency is needed, found {freq}")
    n, unit = _UNITS[m[2]]
    return f"{int(m[1] or 1) * n} {unit}"


def at_period_end(freq: str) -> bool:
    return freq.rstrip("0123456789").endswith("E") and freq != "E"


def with_components(settings: dict, components) -> dict:
    """Template settings with what a configuration says of single components on top; unknown names are an error."""
    out = dict(settings)

    def known(name: str, given: dict, names: tuple[str, ...]) -> dict:
        if extra := set(given) - set(names):
            raise ValueError(f"unknown keys of {name}: {sorted(extra)}")
        return given

    if g := known("growth", components.growth, ("growth_term",)):
        out["growth"] = _GROWTH.get(g["growth_term"], g["growth_term"])
    if components.changepoints:
        c = known("changepoints", components.changepoints, ("method", "n", "dates", "strength", "freq"))
        out["changepoints"] = None if c.get("method", "auto") is None else {"method": "auto", "strength": 0.6} | c
    for name, order in known("seasonality", components.seasonality, tuple(seasonality.COMPONENTS)).items():
        orders = dict(out["seasonality"])
        orders.pop(name, None)
        if order is True or order == "auto":
            order = seasonality.COMPONENTS[name].order
        out["seasonality"] = orders | ({name: int(order)} if order else {})
    if components.events:
        e = known("events", components.events, ("countries", "holidays", "days", "daily"))
        out["events"] = e
        out["holiday_days"] = e.get("days", out["holiday_days"] if out["holiday_days"] is not None else 0) if e.get("holidays", True) else None
    if components.autoregression:
        out["autoreg"] = known("autoregression", components.autoregression, ("autoreg",))["autoreg"]
    out["regressors"] = list(known("regressors", components.regressors, ("columns",)).get("columns", []))
    out["lagged_regressors"] = dict(components.lagged_regressors)
    out["uncertainty"] = known("uncertainty", components.uncertainty, ("by", "method", "min_rows", "small_quantile", "quantiles"))
    out |= {k: v for k, v in known("custom", components.custom, ("grid", "extra_terms", "algorithm", "params", "drop_terms", "lower", "upper")).items() if k != "grid"}
    return out


@dataclass
class ForecastResult:
    """What a run gives: the model, its forecast, the backtest with metrics (over all series), and the scores of all configurations.

    ``scores`` has the metrics of the backtest by series, where there are keys.
    """

    model: linear_model.LinearModel | series_models.SeriesModels
    forecast: DataFrame
    backtest: DataFrame
    metrics: dict[str, float]
    search: list[dict] = field(default_factory=list)
    settings: dict = field(default_factory=dict)
    scores: DataFrame | None = None


def best_of(search: list[dict], metric: str) -> dict:
    """The configuration with the best mean, of equal ones the first; those without a score (a metric that is null) don't count."""
    known = [r for r in search if r["mean"] is not None]
    if not known:
        raise ValueError(f"{metric} is null for every configuration; choose another metric")
    side = -1 if metric in _MORE_IS_BETTER else 1
    return min(known, key=lambda r: (side * r["mean"], r["config"]))


def _one_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of one series, whose frequency stands for all."""
    if not keys:
        return df
    first = df.select(*keys).filter(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)) == F.lit(False)).limit(1)
    return df.join(F.broadcast(first), keys)


def canonical_series(df: DataFrame, interval: str, keys: list[str], train_end: object = None, regressors: list[str] | tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Many series in canonical form (first row of a time, gaps filled, infinities null), and their rows up to the last value or ``train_end``."""
    single = timegrid.dedupe_keep_first(df.withColumn("_at", F.monotonically_increasing_id()), ["_at"], keys).drop("_at")
    full = timegrid.fill_gaps(single, interval, keys).withColumn(VALUE, finite(VALUE))
    last = full.filter(F.col(VALUE).isNotNull()).groupBy(*keys).agg(F.max(TIME).alias("_end"))
    fit = full.join(last, keys).filter(F.col(TIME) <= F.col("_end")).drop("_end")
    return full, fit if train_end is None else fit.filter(F.col(TIME) <= F.lit(train_end).cast("timestamp_ntz"))


class Forecaster:
    """Canonical data, templates to settings, choice by rolling origins, backtest, final fit and forecast of one series or many.

    Series of ``metadata.keys`` go through the same jobs: each has a model of its own; they share the configuration (the
    best on average over all series) and automatic changepoints (those of their mean). The number of Spark jobs depends on
    neither series, splits nor configurations. Algorithms that aren't fitted from sums of products (quantile regression,
    gamma, trees) run for one series, a split after the other.
    """

    def __init__(self, countries: tuple[str, ...] = ("US", "GB", "IN", "FR", "DE")):
        self.countries = countries

    def _spec(self, settings: dict, df: DataFrame, interval: str, seconds: float, days: float, horizon: int, coverage: float | None, keys: tuple = ()) -> tuple[linear_model.ModelSpec, DataFrame | None]:
        spark = df.sparkSession
        orders = {k: n for k, n in settings["seasonality"].items() if days >= seasonality.COMPONENTS[k].min_days}
        points: list = []
        if settings.get("changepoints") and days >= 60:
            c = settings["changepoints"]
            df = df.groupBy(TIME).agg(F.avg(VALUE).alias(VALUE)) if keys else df
            if c["method"] == "custom":
                points = list(c["dates"])
            elif c["method"] == "uniform":
                points = [r[TIME] for r in changepoints.evenly_spaced_times(df, c["n"]).orderBy("k").collect()]  # n dates
            else:
                points = changepoints.trend_changepoints(df, 20, min(8, orders.get("yearly", 0)), c.get("freq", "7D") if seconds <= 86400 else None, c["strength"], skip_last_days=min(90, days / 5))
        said = settings.get("events") or {}
        table, event_keys = None, []
        if settings.get("holiday_days") is not None and seconds <= 86400:
            span = df.agg(F.year(F.min(TIME)).alias("a"), F.year(F.max(TIME)).alias("b")).first()
            named = events.holidays(spark, said.get("countries", self.countries), span.a, span.b + 1)
            # all holidays together have one key and its neighbours; otherwise those named have their own
            separate = [] if settings.get("holidays_together") else said["holidays"] if isinstance(said.get("holidays"), list) else _HOLIDAYS
            width, bare = settings["holiday_days"], [*(events.key_of(h) for h in separate), "Other"]
            table = events.expand_window(events.event_keys(named, separate), width, width)
            event_keys = [k + side for k in bare for side in ("", *(f"_{s}_{n}" for s in ("minus", "plus") for n in range(1, width + 1)))]
        if said.get("daily"):
            own = spark.createDataFrame([(k, d, "event") for k, dates in said["daily"].items() for d in dates], "event_key string, date string, event_name string").withColumn("date", F.to_date("date"))
            table = own if table is None else table.unionByName(own)
            event_keys = [*event_keys, *said["daily"]]
        auto = settings.get("autoreg")
        if auto and not isinstance(auto, dict):
            auto = lags.auto_lags(seconds / 86400, horizon, False)
        terms = templates.feature_sets(seconds, days) if settings.get("feature_sets") == "AUTO" else []
        u = None
        if coverage:
            u = {"by": ["dow_hr"] if seconds <= 3600 else [], "quantiles": ((1 - coverage) / 2, (1 + coverage) / 2)} | settings.get("uncertainty", {})
        more = {k: settings[k] for k in ("lower", "upper", "drop_terms", "regressors", "lagged_regressors") if settings.get(k) is not None}
        if "lagged_regressors" in more:
            # "auto" stands for the usual lags at this horizon; beyond 30 days there are none
            chosen = {c: lags.auto_lagged_regressor(seconds / 86400, horizon) if t == "auto" else t for c, t in more["lagged_regressors"].items()}
            more["lagged_regressors"] = {c: t for c, t in chosen.items() if t}
        params = settings.get("params", {"alpha": 1.0} if settings["algorithm"] == "ridge" else {})
        spec = linear_model.ModelSpec(settings["growth"], points, orders, event_keys, auto, extra_terms=[*terms, *settings.get("extra_terms", [])], algorithm=settings["algorithm"], params=params, uncertainty=u, interval=interval, **more)
        return spec, table

    def run(self, df: DataFrame, config: ForecastConfig) -> ForecastResult:
        """Regressors need their values in the rows after the last value of the series, which are forecast then.

        Periods that are named by their last day are handled by the first day of the next, a calendar step apart.
        """
        meta, ev, keys = config.metadata, config.evaluation, list(config.metadata.keys)
        columns = [*config.components.regressors.get("columns", []), *config.components.lagged_regressors]
        base = df.select(*keys, F.col(meta.time_col).cast("timestamp_ntz").alias(TIME), F.col(meta.value_col).cast("double").alias(VALUE), *dict.fromkeys(columns))
        freq = meta.freq or timegrid.infer_frequency(_one_of(base, keys))
        interval, ends = interval_of(freq), at_period_end(freq)
        if ends:
            base = base.withColumn(TIME, F.col(TIME) + F.expr("interval 1 day"))
        if keys:
            full, fit_df = canonical_series(base, interval, keys, meta.train_end, columns)
        else:
            canonical = timegrid.canonicalise(base, interval, train_end=meta.train_end, regressors=columns)
            full, fit_df = canonical.df, canonical.fit_df
        full, fit_df = (staged(x, "canonical") for x in (full, fit_df))
        sizes = timegrid.history_days(fit_df, keys)
        # the shortest series bounds the splits, the longest has the seasons
        stats = sizes.agg(F.min("period").alias("period"), F.max("num_training_days").alias("days"), F.min("data_points").alias("n")).first()
        seconds, days, n = stats.period, stats.days, stats.n
        horizon = config.horizon or timegrid.default_horizon(seconds, n)
        cv_horizon = ev.cv_horizon or horizon
        step = ev.periods_between_splits or cv_horizon
        possible = max(0, (n - cv_horizon - (ev.cv_min_train or 2 * cv_horizon)) // step + 1)
        names = templates.auto_template(freq, horizon, possible, cv_horizon, ev.cv_max_splits) if config.template == "AUTO" else templates.TEMPLATES.get(config.template, [config.template])
        grid = config.components.custom.get("grid", {})
        # the grid has the last word
        choices = [with_components(c, config.components) | {k: c[k] for k in grid} for c in templates.expand(names, grid)]
        summed = all(c["algorithm"] in series_models.ALGORITHMS for c in choices)
        if keys and not summed:
            raise ValueError("with keys every algorithm has to be one of " + ", ".join(series_models.ALGORITHMS))
        search = []
        if len(choices) > 1:
            splits = evaluation.rolling_splits(n, cv_horizon, ev.cv_min_train, step, ev.periods_between_train_test, ev.cv_expanding, ev.cv_max_splits)
            if summed:
                scores = self._search(fit_df, choices, interval, seconds, days, cv_horizon, rolling_search.splits_from_end(splits, n, ev.cv_expanding), ev.metric, keys)
            else:
                scores = [[self._score(fit_df, s, interval, seconds, days, train, test, ev.metric) for train, test in splits] for s in choices]
            for k, own in enumerate(scores):
                known = [x for x in own if x is not None]
                search.append({"config": k, "settings": choices[k], "scores": own, "mean": sum(known) / len(known) if known else None})
            best = best_of(search, ev.metric)["settings"]
        else:
            best = choices[0]
        # a test part that is asked for is taken as it is; the usual one leaves most of a short series for training
        test_n = ev.test_horizon if ev.test_horizon is not None else min(horizon, n // 5)
        if test_n >= n:
            raise ValueError(f"a test part of {test_n} rows leaves none of {n} for training")
        split = timegrid.train_test_split(fit_df, test_n, keys)
        train, test = split.filter("not is_test").drop("is_test"), split.filter("is_test").drop("is_test")
        spec, table = self._spec(best, fit_df, interval, seconds, days, horizon, config.coverage, keys)
        if summed:
            past, past_table = self._spec(best, train, interval, seconds, days, test_n, config.coverage, keys) if best.get("changepoints") else (spec, table)
            earlier = series_models.fit_series(train, past, keys, past_table)
            back = staged(series_models.predict_series(earlier, test.drop(VALUE)).drop("part"), "backtest")
            earlier.free()
            model = series_models.fit_series(fit_df, spec, keys, table)
            future = series_models.future_of(model, horizon)
        else:
            back = self._forecast(train, test.drop(VALUE), best, interval, seconds, days, test_n, config.coverage)
            model = linear_model.fit_linear(fit_df, spec, table)
            future = linear_model.future_rows(df.sparkSession, model, horizon)
        backtest = back.join(test.select(*keys, TIME, F.col(VALUE).alias(ACTUAL)), [*keys, TIME])
        found = metrics.evaluate(backtest).first().asDict() if test_n else {}
        if test_n and ev.agg_periods:
            found |= {f"{k}_agg": v for k, v in metrics.evaluate_preaggregated(backtest, ev.agg_periods, keys=keys).agg(*[F.avg(m).alias(m) for m in ("MAE", "RMSE")]).first().asDict().items()}
        if columns:
            future = future.join(full.drop(VALUE), [*keys, TIME], "left")
        forecast = series_models.predict_series(model, future).drop("part") if summed else linear_model.predict_linear(model, future)
        if ends:
            forecast, backtest = (x.withColumn(TIME, F.col(TIME) - F.expr("interval 1 day")) for x in (forecast, backtest))
        return ForecastResult(model, forecast, backtest, found, search, best, metrics.evaluate(backtest, keys) if keys and test_n else None)

    def _search(self, df, choices, interval, seconds, days, horizon, splits, metric, keys) -> list[list[float | None]]:
        """Scores of all configurations and splits (the mean over series), from one search."""
        made = [self._spec(c, df, interval, seconds, days, horizon, None, keys) for c in choices]
        tables = [t for _, t in made if t is not None]
        table = reduce(DataFrame.unionByName, tables).distinct() if tables else None
        scores = rolling_search.rolling_scores(df, [s for s, _ in made], splits, keys, table, [metric])
        found = {(r.config, r.split): r.m for r in scores.groupBy("config", "split").agg(F.avg(metric).alias("m")).collect()}  # configurations x splits
        unstage(scores)
        return [[found.get((k, j)) for j in range(len(splits))] for k in range(len(choices))]

    def _forecast(self, train, rows, settings, interval, seconds, days, horizon, coverage):
        spec, table = self._spec(settings, train, interval, seconds, days, horizon, coverage)
        return linear_model.predict_linear(linear_model.fit_linear(train, spec, table), rows)

    def _score(self, df, settings, interval, seconds, days, train, test, metric):
        from pyspark.sql import Window

        numbered = df.withColumn("_i", F.row_number().over(Window.orderBy(TIME)) - 1)
        a = numbered.filter(F.col("_i").between(train.start, train.stop - 1)).drop("_i")
        b = numbered.filter(F.col("_i").between(test.start, test.stop - 1)).drop("_i")
        f = self._forecast(a, b.drop(VALUE), settings, interval, seconds, days * len(train) / max(1, train.stop), len(test), None)
        return metrics.evaluate(f.join(b.withColumnRenamed(VALUE, ACTUAL), TIME), names=[metric]).first()[metric]


class AnomalyDetector:
    """Forecast, then intervals whose width and slices are fitted to labels or to a target share of anomalies."""

    def __init__(self, forecast: ForecastConfig, detection: DetectionConfig):
        self.forecast_config, self.detection = forecast, detection
        self.detector: detect.IntervalDetector | None = None
        self.model: linear_model.LinearModel | None = None

    def fit(self, df: DataFrame, anomalies: DataFrame | None = None) -> AnomalyDetector:
        """``anomalies`` are intervals; outliers far out are added to them, and none of their rows train the model."""
        meta = self.forecast_config.metadata
        base = df.select(F.col(meta.time_col).cast("timestamp_ntz").alias(TIME), F.col(meta.value_col).cast("double").alias(VALUE))
        freq = meta.freq or timegrid.infer_frequency(base)
        interval = interval_of(freq)
        sources = [detect.anomaly_from_outliers(base, VALUE)] + ([anomalies] if anomalies is not None else [])
        merged = detect.merge_anomaly_sources(sources, interval)
        full = timegrid.fill_gaps(base, interval)
        known = clean.adjust_intervals(full, merged, [VALUE])
        result = Forecaster().run(known.select(TIME, VALUE), self.forecast_config)
        self.model = result.model
        fitted = (series_models.fitted_series if isinstance(result.model, series_models.SeriesModels) else linear_model.fitted_values)(result.model).select(TIME, FORECAST)
        truth = clean.adjust_intervals(full.withColumnRenamed(VALUE, ACTUAL), merged if anomalies is None else anomalies, [], label="is_anomaly")
        rows = self._features(truth.join(fitted, TIME).filter(F.col(ACTUAL).isNotNull()))
        c = self.detection
        reward = detect.config_reward(c.objective, c.target_percent, min_precision=c.min_precision, min_recall=c.min_recall)
        self.detector = detect.IntervalDetector(reward, c.coverage_grid or detect.COVERAGES, [tuple(v) for v in c.volatility_features], c.ape_thresholds, c.sape_thresholds).fit(rows)
        return self

    @staticmethod
    def _features(df: DataFrame) -> DataFrame:
        from tidewater.functions.calendar import add_time_features

        return add_time_features(df, ["dow", "hour", "is_weekend", "dow_hr"])

    def predict(self, df: DataFrame) -> DataFrame:
        """New rows, after the training rows, with forecast, band, z-score and label."""
        meta = self.forecast_config.metadata
        rows = df.select(F.col(meta.time_col).cast("timestamp_ntz").alias(TIME), F.col(meta.value_col).cast("double").alias(ACTUAL))
        f = (series_models.predict_series if isinstance(self.model, series_models.SeriesModels) else linear_model.predict_linear)(self.model, rows.select(TIME)).select(TIME, FORECAST)
        return self.detector.predict(self._features(rows.join(f, TIME)))

    def intervals(self, df: DataFrame) -> DataFrame:
        return labels.label_to_intervals(self.predict(df), "is_anomaly_predicted")


__all__ = ["AnomalyDetector", "DetectionConfig", "ForecastConfig", "ForecastResult", "Forecaster", "simple_frequency"]
