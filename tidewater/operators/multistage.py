"""Forecasts in stages: each stage has its own frequency, length of training and regression, and is fitted to what the earlier ones leave.

A long fine series needs its fine rows only for what changes fast: a coarse stage over all of its history takes trend and
yearly season, a fine stage over the last weeks takes the rest. What the stages have explained so far is a column of the
keyed table of all rows; each stage aggregates its residuals to its bins, fits all series in one job (``series_models``),
and its fitted values join the rows by series and bin. Stages run in order of their training lengths, longest first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import intervals, series_models
from tidewater.operators.linear_model import ModelSpec
from tidewater.operators.timegrid import AGGREGATES, bin_start, fill_gaps
from tidewater.schema import ERR_STD, FORECAST, QUANTILES, TIME, VALUE
from tidewater.staging import staged, unstage

#: The spacing of the bins of each frequency.
BINS = {"H": "1 hour", "D": "1 day", "W-MON": "7 days", "MS": "1 month"}
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400, "year": 365 * 86400}


def length_seconds(length: str | None) -> float:
    """Seconds of a length such as "56 days"; endless for None."""
    if length is None:
        return float("inf")
    n, unit = length.split()
    return int(n) * _SECONDS[unit.rstrip("s")]


@dataclass
class Stage:
    """Bins (None: the rows as they are), how values and regressors of a bin are combined, lengths back from the last row, and the model.

    Fitted values reach back ``fit_length``, at least as far as training.
    """

    spec: ModelSpec
    freq: str | None = None
    train_length: str | None = None
    fit_length: str | None = None
    agg: str = "mean"

    def bin(self, ts: str) -> Column:
        return F.col(ts) if self.freq is None else bin_start(F.col(ts), self.freq)


@dataclass
class MultistageModel:
    stages: list[Stage]
    keys: list[str]
    interval: str
    models: list[series_models.SeriesModels] = field(default_factory=list)
    fitted: DataFrame | None = None
    slices: DataFrame | None = None
    fallback: DataFrame | None = None
    by: list[str] = field(default_factory=list)

    def free(self) -> None:
        """Delete the tables of all stages."""
        for m in self.models:
            m.free()
        unstage(*[t for t in (self.fitted, self.slices, self.fallback) if t is not None])


def _regressors(stage: Stage) -> list[str]:
    return list(dict.fromkeys([*stage.spec.regressors, *stage.spec.lagged_regressors]))


def stage_rows(rest: DataFrame, stage: Stage, interval: str, keys: Sequence[str] = (), ts: str = TIME, value: str = VALUE) -> DataFrame:
    """The bins that a stage trains on: residuals of the rows in its training length, without bins that the first or last
    row of the series cuts. ``rest`` has ``_last``, the last time of each series."""
    length = length_seconds(stage.train_length)
    own = rest
    if stage.train_length is not None:
        own = own.filter(F.unix_timestamp(F.col("_last").cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp")) < length)
    if stage.freq is None:
        return own.select(*keys, ts, value, *_regressors(stage))
    binned = own.withColumn("_bin", stage.bin(ts))
    step = F.expr(f"interval {interval}")
    aggs = [AGGREGATES[stage.agg](F.col(value)).alias(value), *[AGGREGATES[stage.agg](F.col(r).cast("double")).alias(r) for r in _regressors(stage)], F.min(ts).alias("_a"), F.max(ts).alias("_b")]
    bins = binned.groupBy(*keys, "_bin").agg(*aggs)
    ends = bins.groupBy(*keys).agg(F.min("_a").alias("_start"), F.max("_b").alias("_end"))
    bins = series_models._meet(bins, ends, keys)
    before = replace_time(stage, F.col("_start") - step)
    after = replace_time(stage, F.col("_end") + step)
    whole = bins.filter((F.col("_bin") != before) & (F.col("_bin") != after))
    full = whole.select(*keys, F.col("_bin").alias(ts), value, *_regressors(stage))
    return fill_gaps(full, BINS[stage.freq], keys, ts)


def replace_time(stage: Stage, t: Column) -> Column:
    """The bin of a time that is an expression."""
    return t if stage.freq is None else bin_start(t, stage.freq)


def fit_multistage(df: DataFrame, stages: Sequence[Stage], interval: str, keys: Sequence[str] = (), events: DataFrame | None = None, uncertainty: dict | None = None, ts: str = TIME, value: str = VALUE) -> MultistageModel:
    """Fit all stages of all series. ``interval`` is the spacing of the rows; ``uncertainty`` as in ``ModelSpec``, of the residuals of all stages together."""
    if not stages:
        raise ValueError("at least one stage is needed")
    keys, ordered = list(keys), sorted(stages, key=lambda s: -length_seconds(s.train_length))
    used = list(dict.fromkeys(r for s in ordered for r in _regressors(s)))
    last = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(ts).alias("_last"))
    rows = series_models._meet(df.select(*keys, ts, F.col(value).cast("double").alias(value), *used), last, keys)
    rest = staged(rows.filter(F.col(ts) <= F.col("_last")).withColumn("_cum", F.lit(0.0)), "multistage")
    model = MultistageModel([], keys, interval)
    for stage in ordered:
        spec = replace(stage.spec, interval=interval if stage.freq is None else BINS[stage.freq])
        stage = replace(stage, spec=spec)
        left = rest.withColumn(value, F.col(value) - F.col("_cum"))
        fitted = series_models.fit_series(staged_rows := staged(stage_rows(left, stage, interval, keys, ts, value), "stage"), spec, keys, events, ts, value)
        fitted.staged.append(staged_rows)
        model.stages.append(stage)
        model.models.append(fitted)
        back = max(length_seconds(stage.train_length), length_seconds(stage.fit_length) if stage.fit_length else 0)
        recent = rest if back == float("inf") else rest.filter(F.unix_timestamp(F.col("_last").cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp")) < back)
        after = _joined(recent, model, len(model.models) - 1, ts, value)
        kept = rest.columns
        # rows that a stage doesn't reach have no residual any more and leave the table
        done = after.withColumn("_cum", F.col("_cum") + F.col("_f")).select(*kept)
        new = staged(done, "multistage")
        unstage(rest)
        rest = new
    model.fitted = rest
    if uncertainty:
        from tidewater.functions.calendar import add_time_features

        model.by = list(uncertainty.get("by", ()))
        errors = rest.withColumn("_res", F.col(value) - F.col("_cum"))
        if model.by:
            errors = add_time_features(errors, model.by, ts)
        slices, fallback = series_models.keyed_intervals(errors, "_res", keys, uncertainty.get("quantiles", (0.025, 0.975)), model.by, uncertainty.get("method", "normal_fit"), uncertainty.get("min_rows", 5), uncertainty.get("small_quantile", 0.98))
        model.slices, model.fallback = (None if slices is None else staged(slices, "slices")), staged(fallback, "fallback")
    return model


def _joined(rows: DataFrame, model: MultistageModel, k: int, ts: str, value: str) -> DataFrame:
    """Rows with ``_f``: the forecast of stage k for the bin of each."""
    stage, keys = model.stages[k], model.keys
    binned = rows.withColumn("_bin", stage.bin(ts))
    extra = [AGGREGATES[stage.agg](F.col(r).cast("double")).alias(r) for r in _regressors(stage)]
    bins = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_rows"), *extra).withColumnRenamed("_bin", ts)
    f = series_models.predict_series(model.models[k], bins.drop("_rows"), ts, value).select(*keys, F.col(ts).alias("_bin"), F.col(FORECAST).alias("_f"))
    return binned.join(f, [*keys, "_bin"], "left").drop("_bin")


def predict_multistage(model: MultistageModel, rows: DataFrame, ts: str = TIME, value: str = VALUE) -> DataFrame:
    """The rows with forecast_0, forecast_1, ... of the stages, forecast (their sum) and interval columns where the model has them."""
    out, parts = rows, []
    for k in range(len(model.stages)):
        parts.append(f"{FORECAST}_{k}")
        out = _joined(out, model, k, ts, value).withColumnRenamed("_f", parts[-1])
    out = out.withColumn(FORECAST, reduce(lambda a, b: a + b, [F.col(p) for p in parts]))
    if model.fallback is None:
        return out
    from tidewater.functions.calendar import add_time_features

    new = [c for c in model.by if c not in out.columns]
    out = add_time_features(out, new, ts) if new else out
    out = series_models._meet(out, model.fallback.select(*model.keys, F.col("qs").alias("_fq"), F.col(ERR_STD).alias("_fs")), model.keys, "left")
    if model.slices is not None:
        out = out.join(model.slices.select(*model.keys, *model.by, F.col("qs").alias("_q"), F.col(ERR_STD).alias("_s")), [*model.keys, *model.by], "left")
    else:
        out = out.withColumns({"_q": F.col("_fq"), "_s": F.col("_fs")})
    out = out.withColumns({QUANTILES: intervals.offset_array(F.coalesce("_q", "_fq"), F.col(FORECAST)), ERR_STD: F.coalesce("_s", "_fs")})
    return intervals.with_bounds(out).drop("_q", "_s", "_fq", "_fs", *new)
