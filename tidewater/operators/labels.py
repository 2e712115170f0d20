"""Anomaly labels: intervals, label metrics, soft and range-based scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.schema import ANOMALY, END, PREDICTED_ANOMALY, START, TIME


def with_islands(df: DataFrame, flag: str, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Rows where ``flag`` holds, with _pos (row of the series, from 1) and _island (one value per run of such rows)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    numbered = df.withColumn("_pos", F.row_number().over(w)).filter(F.col(flag))
    return numbered.withColumn("_island", F.col("_pos") - F.row_number().over(w))


def label_to_intervals(df: DataFrame, flag: str = ANOMALY, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """(start, end) of every run of labelled rows, both inclusive."""
    return with_islands(df, flag, keys, ts).groupBy(*keys, "_island").agg(F.min(ts).alias(START), F.max(ts).alias(END)).drop("_island")


def merge_intervals(intervals: DataFrame, period: str, keys: Sequence[str] = (), start: str = START, end: str = END) -> DataFrame:
    """Intervals that overlap or lie at most one period apart become one. An interval that ends before it starts is an error."""
    if intervals.filter(F.col(start) > F.col(end)).limit(1).count():
        raise ValueError("an interval ends before it starts")
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + F.expr(f"interval {period}")), 1).otherwise(0)
    grouped = intervals.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def confusion(df: DataFrame, keys: Sequence[str] = (), true: str = ANOMALY, pred: str = PREDICTED_ANOMALY) -> DataFrame:
    """Rows by truth and prediction."""
    return df.groupBy(*keys, true, pred).agg(F.count("*").alias("n"))


def label_counts(true: Column, pred: Column) -> dict[str, Column]:
    return {"tp": F.count_if(true & pred), "fp": F.count_if(~true & pred), "fn": F.count_if(true & ~pred), "tn": F.count_if(~true & ~pred)}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def label_metrics(df: DataFrame, keys: Sequence[str] = (), true: str = ANOMALY, pred: str = PREDICTED_ANOMALY) -> DataFrame:
    """Precision, recall and F1 of both classes, Matthews correlation and informedness; 0 where a denominator is."""
    n = df.groupBy(*keys).agg(*[c.alias(k) for k, c in label_counts(F.col(true), F.col(pred)).items()])
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return n.select(
        *keys,
        "tp",
        "fp",
        "fn",
        "tn",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tn, tn + fn).alias("precision_0"),
        _ratio(tn, tn + fp).alias("recall_0"),
        _ratio(2 * tn, 2 * tn + fp + fn).alias("f1_0"),
        _ratio(tp * tn - fp * fn, root).alias("mcc"),
        (_ratio(tp, tp + fn) + _ratio(tn, tn + fp) - 1).alias("informedness"),
    )


def soft_metrics(df: DataFrame, window: int, keys: Sequence[str] = (), ts: str = TIME, true: str = ANOMALY, pred: str = PREDICTED_ANOMALY) -> DataFrame:
    """Precision, recall and F1 where a label within ``window`` rows counts; F1 is null when both others are 0."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-window, window)
    near = df.withColumns({"_t": F.max(F.col(true).cast("int")).over(w) == 1, "_p": F.max(F.col(pred).cast("int")).over(w) == 1})
    out = near.groupBy(*keys).agg(
        _ratio(F.count_if(F.col(true) & F.col("_p")), F.count_if(true)).alias("soft_recall"),
        _ratio(F.count_if(F.col(pred) & F.col("_t")), F.count_if(pred)).alias("soft_precision"),
    )
    p, r = F.col("soft_precision"), F.col("soft_recall")
    return out.withColumn("soft_f1", F.when(p + r > 0, 2 * p * r / (p + r)))


def _reward(i: Column, length: Column, bias: str) -> Column:
    """Weight of the i-th row (from 1) of a range of ``length`` rows."""
    if bias == "flat":
        return F.lit(1.0)
    if bias == "front":
        return (length - i + 1).cast("double")
    if bias == "back":
        return i.cast("double")
    if bias == "middle":
        return F.when(i <= length / 2, i).otherwise(length - i + 1).cast("double")
    raise ValueError(f"unknown bias {bias}")


def range_score(df: DataFrame, side: str, other: str, alpha: float = 0.5, bias: str = "flat", cardinality: str | None = None, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Mean over the ranges of ``side`` of alpha * (any overlap) + (1 - alpha) * cardinality factor * rewarded overlap share.

    Precision has the prediction as ``side``, recall the truth. Without ranges there is no row. With cardinality
    "reciprocal" the overlap share is divided by the number of ranges of ``other`` that meet the range.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    numbered = df.withColumns({"_pos": F.row_number().over(w), "_start": F.coalesce(F.col(other) & ~F.coalesce(F.lag(other).over(w), F.lit(False)), F.lit(False))})
    runs = numbered.filter(F.col(side)).withColumn("_island", F.col("_pos") - F.row_number().over(w))
    inside = Window.partitionBy(*keys, "_island")
    i, length = F.row_number().over(inside.orderBy(ts)), F.count("*").over(inside)
    rows = runs.withColumns({"_i": i, "_len": length})
    # a range of the other side that reaches into this one from before has no start inside
    met = F.count_if(F.col("_start") | ((F.col("_i") == 1) & F.col(other) & ~F.col("_start")))
    reward = _reward(F.col("_i"), F.col("_len"), bias)
    per_range = rows.groupBy(*keys, "_island").agg(met.alias("_met"), F.sum(F.when(F.col(other), reward).otherwise(0.0)).alias("_got"), F.sum(reward).alias("_all"))
    factor = F.when(F.col("_met") > 1, 1 / F.col("_met")).otherwise(1.0) if cardinality == "reciprocal" else F.lit(1.0)
    score = alpha * (F.col("_met") > 0).cast("double") + (1 - alpha) * factor * F.col("_got") / F.col("_all")
    return per_range.groupBy(*keys).agg(F.avg(score).alias("score"))


def range_precision(df: DataFrame, true: str = ANOMALY, pred: str = PREDICTED_ANOMALY, **params) -> DataFrame:
    return range_score(df, pred, true, **params).withColumnRenamed("score", "range_precision")


def range_recall(df: DataFrame, true: str = ANOMALY, pred: str = PREDICTED_ANOMALY, **params) -> DataFrame:
    return range_score(df, true, pred, **params).withColumnRenamed("score", "range_recall")


def floor_time(ts: Column, freq: str) -> Column:
    return F.date_trunc({"H": "HOUR", "D": "DAY", "W": "WEEK", "MS": "MONTH", "QS": "QUARTER", "YS": "YEAR", "min": "MINUTE"}[freq], ts).cast("timestamp_ntz")


def ceil_time(ts: Column, freq: str) -> Column:
    step = {"H": "1 hour", "D": "1 day", "W": "7 days", "MS": "1 month", "QS": "3 months", "YS": "1 year", "min": "1 minute"}[freq]
    down = floor_time(ts, freq)
    return F.when(down == ts, ts).otherwise(down + F.expr(f"interval {step}"))
