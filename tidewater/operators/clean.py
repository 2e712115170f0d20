"""Cleaning: imputation, outliers, normalisation, degenerate columns and adjustments by interval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.lags import array_median
from tidewater.schema import ADJUSTMENT, END, START, TIME, VALUE

#: Cutoffs and quantiles of the outlier rules.
Z_CUTOFF, TUKEY_CUTOFF, TUKEY_LOWER, TUKEY_UPPER, DETECTION_Z_CUTOFF, DETECTION_TRIM = 5.0, 1.0, 0.1, 0.9, 20.0, 0.01
MEDIAN_WINDOW = 5
#: Ranks of up to so many distinct values are sent to every executor.
BROADCAST_VALUES = 50_000


def interpolate(df: DataFrame, value: str = VALUE, keys: Sequence[str] = (), ts: str = TIME, out: str | None = None) -> DataFrame:
    """Nulls on a straight line between their neighbours by row position; at the ends the nearest value."""
    w = Window.partitionBy(*keys).orderBy(ts)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    numbered = df.withColumn("_i", F.row_number().over(w))
    both = numbered.withColumns({"_p": F.last(known, ignorenulls=True).over(back), "_n": F.first(known, ignorenulls=True).over(ahead)})
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p.i")) / F.nullif(F.col("_n.i") - F.col("_p.i"), F.lit(0))
    return both.withColumn(out or value, F.coalesce(F.col(value), line, F.col("_p.v"), F.col("_n.v"))).drop("_i", "_p", "_n")


def impute_with_lags(df: DataFrame, value: str = VALUE, orders: Sequence[int] = (7, 14, 21), iterations: int = 5, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Nulls by the mean of the given lags that are there, again and again with what was filled before."""
    w = Window.partitionBy(*keys).orderBy(ts)
    for _ in range(iterations):
        lags = [F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w) for k in orders]
        n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in lags), F.lit(0))
        mean = sum((F.coalesce(c, F.lit(0.0)) for c in lags), F.lit(0.0)) / F.nullif(n, F.lit(0))
        df = df.withColumn(value, F.coalesce(F.col(value), mean))
    return df


def impute(df: DataFrame, how: str = "interpolate", value: str = VALUE, keys: Sequence[str] = (), ts: str = TIME, max_frac: float = 0.1, **params) -> DataFrame:
    """Impute by name; series whose share of nulls is above ``max_frac`` get a warning column."""
    share = F.avg(F.col(value).isNull().cast("double")).over(Window.partitionBy(*keys))
    df = df.withColumn("too_many_nulls", share > max_frac)
    if how == "interpolate":
        return interpolate(df, value, keys, ts)
    if how == "ts_interpolate":
        return interpolate(impute_with_lags(df, value, keys=keys, ts=ts, **params), value, keys, ts)
    raise ValueError(f"unknown imputation {how}")


def trimmed(df: DataFrame, value: str, trim: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows without the lowest and highest ``trim`` share; where fewer than two rows would stay, all of them."""
    known = df.filter(F.col(value).isNotNull())
    if trim <= 0:
        return known
    half = trim / 2
    w = Window.partitionBy(*keys)
    marked = known.withColumn("_q", F.percentile(value, F.array(F.lit(half), F.lit(1 - half))).over(w))
    inside = (F.col(value) >= F.col("_q")[0]) & (F.col(value) <= F.col("_q")[1])
    kept = marked.withColumn("_n", F.sum(inside.cast("int")).over(w))
    return kept.filter(inside | (F.col("_n") < 2)).drop("_q", "_n")


def _with_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(stats, list(keys), "left") if keys else df.crossJoin(F.broadcast(stats))


def baseline_difference(df: DataFrame, method: str | None, value: str = VALUE, keys: Sequence[str] = (), ts: str = TIME, alpha: float = 0.5) -> DataFrame:
    """Adds _diff: the value, less a centred moving median over five rows or an exponentially weighted mean."""
    if method is None:
        return df.withColumn("_diff", F.col(value))
    w = Window.partitionBy(*keys).orderBy(ts)
    if method == "moving_med":
        half = MEDIAN_WINDOW // 2
        return df.withColumn("_diff", F.col(value) - array_median(F.collect_list(value).over(w.rowsBetween(-half, half))))
    if method == "es":
        return exponential_mean(df, alpha, value, keys, ts).withColumn("_diff", F.col(value) - F.col("ewm")).drop("ewm")
    raise ValueError(f"unknown baseline {method}")


def exponential_mean(df: DataFrame, alpha: float, value: str = VALUE, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Adds ewm: the weighted mean of all values so far with weights (1 - alpha)^age. A recurrence, so one pandas pass per series."""
    schema = T.StructType([*df.schema, T.StructField("ewm", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        return pdf.assign(ewm=pdf[value].ewm(alpha=alpha, adjust=True, ignore_na=False).mean())

    return df.groupBy(*keys).applyInPandas(run, schema)


def zscore_stats(df: DataFrame, value: str = VALUE, trim: float = DETECTION_TRIM, keys: Sequence[str] = ()) -> DataFrame:
    return trimmed(df, value, trim, keys).groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def zscore_outliers(df: DataFrame, value: str = VALUE, cutoff: float = Z_CUTOFF, trim: float = DETECTION_TRIM, diff: str | None = None, keys: Sequence[str] = (), ts: str = TIME, stats: DataFrame | None = None) -> DataFrame:
    """Adds score and is_outlier: distance from the trimmed mean in trimmed standard deviations (population) over the cutoff."""
    based = baseline_difference(df, diff, value, keys, ts)
    stats = zscore_stats(based, "_diff", trim, keys) if stats is None else stats
    score = (F.col("_diff") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return _with_stats(based, stats, keys).withColumn("score", F.coalesce(score, F.when(F.col("_diff").isNotNull(), 0.0))).withColumn("is_outlier", F.coalesce(F.abs("score") > cutoff, F.lit(False))).drop("_diff", "mean", "sd")


def tukey_outliers(df: DataFrame, value: str = VALUE, cutoff: float = TUKEY_CUTOFF, lower: float = TUKEY_LOWER, upper: float = TUKEY_UPPER, trim: float = DETECTION_TRIM, diff: str | None = None, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Adds score and is_outlier: distance beyond the outer quantiles in interquantile ranges over the cutoff."""
    based = baseline_difference(df, diff, value, keys, ts)
    stats = trimmed(based, "_diff", trim, keys).groupBy(*keys).agg(F.percentile("_diff", F.array(F.lit(lower), F.lit(upper))).alias("_q"))
    q0, q1, d = F.col("_q")[0], F.col("_q")[1], F.col("_diff")
    score = F.when(d > q1, (d - q1) / F.nullif(q1 - q0, F.lit(0.0))).when(d < q0, (d - q0) / F.nullif(q1 - q0, F.lit(0.0))).otherwise(0.0)
    return _with_stats(based, stats, keys).withColumn("score", F.coalesce(score, F.when(d.isNotNull(), 0.0))).withColumn("is_outlier", F.coalesce(F.abs("score") > cutoff, F.lit(False))).drop("_diff", "_q")


def mask_outliers(df: DataFrame, cutoff: float, value: str = VALUE, keys: Sequence[str] = ()) -> DataFrame:
    """Values farther than ``cutoff`` sample standard deviations from the mean become null."""
    w = Window.partitionBy(*keys)
    z = F.abs(F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))
    return df.withColumn(value, F.when(F.coalesce(z > cutoff, F.lit(False)), None).otherwise(F.col(value)))


def lagged_baseline_outliers(df: DataFrame, lags: Sequence[int], score: str = "difference", cutoff: float = Z_CUTOFF, max_share: float = 0.05, value: str = VALUE, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Adds score and is_outlier against the mean of values at the given lags (positive: ahead), at most ``max_share`` of rows."""
    w, every = Window.partitionBy(*keys).orderBy(ts), Window.partitionBy(*keys)
    around = F.filter(F.array(*[F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) for k in lags]), lambda x: x.isNotNull())
    base = F.aggregate(around, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(around), F.lit(0))
    raw = F.col(value) - F.col("_base") if score == "difference" else F.col(value) / F.nullif(F.col("_base"), F.lit(0.0)) - 1
    scored = df.withColumn("_base", base).withColumn("_raw", raw)
    scored = scored.withColumn("score", (F.col("_raw") - F.avg("_raw").over(every)) / F.nullif(F.stddev_pop("_raw").over(every), F.lit(0.0)))
    cap = F.percentile(F.abs("score"), F.lit(1 - max_share)).over(every)
    return scored.withColumn("is_outlier", F.coalesce((F.abs("score") > cutoff) & (F.abs("score") >= cap), F.lit(False))).drop("_base", "_raw")


def normalise(df: DataFrame, cols: Sequence[str], method: str = "zero_to_one", keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Columns shifted and scaled: statistical, zero_to_one, minus_half_to_half or zero_at_origin; zero denominators are 1."""
    w = Window.partitionBy(*keys)
    out = {}
    for c in cols:
        low, spread = F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)
        if method == "statistical":
            shift, scale = F.avg(c).over(w), F.stddev_samp(c).over(w)
        elif method == "zero_to_one":
            shift, scale = low, spread
        elif method == "minus_half_to_half":
            shift, scale = low + spread / 2, spread
        elif method == "zero_at_origin":
            shift, scale = F.first(c).over(w.orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), spread
        else:
            raise ValueError(f"unknown method {method}")
        out[c] = (F.col(c) - shift) / F.when(scale == 0, 1.0).otherwise(scale)
    return df.withColumns(out)


def rank_scaled(df: DataFrame, *cols: str) -> DataFrame:
    """Columns as their ranks among all rows on [0, 1], as percent_rank has it (nulls first, equal values share a rank).

    One pass finds quantiles of all columns. Per column, distinct values are counted and dealt into ranges by quantiles; each
    range is ordered by itself and starts where the counts of those before it end, so that no task orders the whole table.
    Every column is counted in ``df`` itself, not in what the ranks of the columns before it were joined to. Ranks of few
    distinct values are broadcast, so that no row moves for them and no frequent value makes a large task.
    """
    cols = list(dict.fromkeys(cols))
    if not cols:
        return df
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = [k / n for k in range(1, n)]
    found = df.agg(*[F.percentile_approx(c, cuts, 10_000).alias(f"q{k}") for k, c in enumerate(cols)], *[F.approx_count_distinct(c).alias(f"d{k}") for k, c in enumerate(cols)]).first()
    out = df
    for k, c in enumerate(cols):
        ranks = _value_ranks(df, c, found[f"q{k}"] or []).select(F.col("_v").alias(f"_v{k}"), F.col("_rank").alias(f"_rank{k}"))
        few = found[f"d{k}"] <= BROADCAST_VALUES
        out = out.join(F.broadcast(ranks) if few else ranks, F.col(c) == F.col(f"_v{k}"), "left")
    scaled = {c: F.coalesce(f"_rank{k}", F.lit(0.0)) for k, c in enumerate(cols)}  # nulls come first: rank 0
    return out.withColumns(scaled).drop(*[f"{x}{k}" for k in range(len(cols)) for x in ("_v", "_rank")])


def _value_ranks(df: DataFrame, c: str, cuts: Sequence) -> DataFrame:
    """(_v, _rank) per distinct value of a column; ``cuts`` bound the ranges that are ordered by themselves."""
    values = _with_range(df.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n")), cuts)
    sums = values.groupBy("_part").agg(F.sum("_n").alias("_rows"))  # one row per range
    ahead = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_part", ahead.alias("_ahead"), F.sum("_rows").over(Window.partitionBy()).alias("_all"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = values.withColumn("_in", inside).join(F.broadcast(starts), "_part")
    return ranks.select("_v", F.when(F.col("_all") > 1, (F.col("_ahead") + F.col("_in")) / (F.col("_all") - 1)).otherwise(0.0).alias("_rank"))


def _with_range(values: DataFrame, cuts: Sequence) -> DataFrame:
    """Adds _part, how many of the cuts are below _v (nulls: 0), by bisection: a column and a comparison per power of two.

    Never null by its type, or joins on it would have it computed for every row of the table to drop nulls.
    """
    known = sorted({b for b in cuts if b == b})  # a NaN as cut would break the order; as value it is above all cuts
    powers = len(known).bit_length()
    bounds = F.array(*[F.lit(b) for b in known + known[-1:] * ((1 << powers) - 1 - len(known))])  # filled up with the last cut
    values = values.withColumn("_part", F.lit(0))
    for step in (1 << k for k in reversed(range(powers))):
        values = values.withColumn("_part", F.col("_part") + F.when(F.get(bounds, F.col("_part") + (step - 1)) < F.col("_v"), step).otherwise(0))
    return values


def scale_features(df: DataFrame, cols: Sequence[str], name: str = "MinMaxScaler", **params) -> DataFrame:
    """A fitted pyspark.ml scaler by name over the columns as one vector, given back as columns."""
    from pyspark.ml import feature
    from pyspark.ml.functions import vector_to_array

    kinds = {"MinMaxScaler", "MaxAbsScaler", "StandardScaler", "RobustScaler", "Normalizer"}
    if name == "QuantileTransformer":
        return rank_scaled(df, *cols)
    if name not in kinds:
        raise ValueError(f"unknown scaler {name}")
    vector = feature.VectorAssembler(inputCols=list(cols), outputCol="_x").transform(df)
    scaler = getattr(feature, name)(inputCol="_x", outputCol="_z", **params)
    scaled = (scaler.fit(vector) if hasattr(scaler, "fit") else scaler).transform(vector)
    return scaled.withColumn("_z", vector_to_array("_z")).withColumns({c: F.col("_z")[k] for k, c in enumerate(cols)}).drop("_x", "_z")


def degenerate_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with one value throughout; one with any null isn't constant unless all are null."""
    row = df.agg(*[F.min(c).alias(f"a{k}") for k, c in enumerate(cols)], *[F.max(c).alias(f"b{k}") for k, c in enumerate(cols)], *[F.count_if(F.col(c).isNull()).alias(f"n{k}") for k, c in enumerate(cols)]).first()
    return [c for k, c in enumerate(cols) if row[f"a{k}"] == row[f"b{k}"] and row[f"n{k}"] == 0]


def drop_degenerate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*degenerate_columns(df, cols))


def _touched(df: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, start: str, end: str) -> DataFrame:
    """(keys, ts, delta, void) per time that intervals cover: deltas summed; void if any has none.

    Times and intervals meet by day (an interval is spread over its days), then by the exact bounds.
    """
    last = df.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    bounded = intervals.crossJoin(F.broadcast(last)).filter((F.col(start) <= F.col("_b")) & (F.col(end) >= F.col("_a")))
    days = bounded.withColumn("_day", F.explode(F.sequence(F.to_date(F.greatest(start, "_a")), F.to_date(F.least(end, "_b"))))).drop("_a", "_b")
    times = df.select(*keys, ts).distinct().withColumn("_day", F.to_date(ts))
    hit = times.join(days, [*keys, "_day"]).filter(F.col(ts).between(F.col(start), F.col(end)))
    return hit.groupBy(*keys, ts).agg(F.sum(ADJUSTMENT).alias("_delta"), F.bool_or(F.col(ADJUSTMENT).isNull()).alias("_void"))


def adjust_intervals(df: DataFrame, anomalies: DataFrame, values: Sequence[str], adjust: str = "add", keys: Sequence[str] = (), ts: str = TIME, start: str = START, end: str = END, label: str | None = None) -> DataFrame:
    """Values inside intervals (both ends count) plus or minus all their deltas; null where an interval has no delta."""
    if ADJUSTMENT not in anomalies.columns:
        anomalies = anomalies.withColumn(ADJUSTMENT, F.lit(None).cast("double"))
    anomalies = anomalies.select(*keys, F.col(start).cast("timestamp_ntz").alias(start), F.col(end).cast("timestamp_ntz").alias(end), F.col(ADJUSTMENT).cast("double").alias(ADJUSTMENT))
    sign = 1 if adjust == "add" else -1
    joined = df.join(_touched(df, anomalies, keys, ts, start, end), [*keys, ts], "left")
    changed = {v: F.when(F.col("_void").isNull(), F.col(v)).when(F.col("_void"), None).otherwise(F.col(v) + sign * F.col("_delta")) for v in values}
    if label:
        changed[label] = F.col("_void").isNotNull()
    return joined.withColumns(changed).drop("_delta", "_void")


def label_intervals(df: DataFrame, anomalies: DataFrame, metrics: Sequence[str], metric_col: str = "metric", ts: str = TIME, start: str = START, end: str = END) -> DataFrame:
    """Adds {metric}_is_anomaly for each value column, from the intervals of that metric."""
    for m in metrics:
        df = adjust_intervals(df, anomalies.filter(F.col(metric_col) == m), [], ts=ts, start=start, end=end, label=f"{m}_is_anomaly")
    return df


def apply_rows(df: DataFrame, func, cols: Sequence[str], out: str) -> DataFrame:
    """A function over the given columns: a column expression, or any Python function in Arrow batches."""
    try:
        made = func(*[F.col(c) for c in cols])
    except Exception:
        made = None
    if isinstance(made, Column):
        return df.withColumn(out, made)
    schema = T.StructType([*df.schema, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [func(*row) for row in b[list(cols)].itertuples(index=False)]})

    return df.mapInPandas(run, schema)


def summarise(df: DataFrame, value: str = VALUE, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation and quartiles of a value."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    stats = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("_q"), F.max(value).alias("max"))
    return stats.select(*keys, "count", "mean", "std", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max")


