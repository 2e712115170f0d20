"""Streaming additions: live points against a batch-fitted interval model, and windowed sums with late data.

There is no state beyond what Structured Streaming keeps for windows and deduplication.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.intervals import IntervalModel, apply_intervals, with_bounds
from tidewater.schema import ACTUAL, PREDICTED_ANOMALY, TIME


def windowed(stream: DataFrame, aggs: dict[str, Column], width: str, late: str, keys: Sequence[str] = (), ts: str = TIME, slide: str | None = None) -> DataFrame:
    """Aggregates per time window; rows later than ``late`` don't count any more."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(w, *keys).agg(*[c.alias(k) for k, c in aggs.items()])
    return out.select(F.col("window.start").alias(TIME), *keys, *aggs)


def dedupe(stream: DataFrame, ids: Sequence[str], late: str, ts: str = TIME) -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(ids))


def score(stream: DataFrame, forecasts: DataFrame, model: IntervalModel, on: Sequence[str] = (TIME,)) -> DataFrame:
    """Points of a stream with forecast, band and label: joins of the stream with static tables."""
    joined = stream.join(forecasts, list(on))
    banded = with_bounds(apply_intervals(joined, model))
    outside = (F.col(ACTUAL) < F.col("forecast_lower")) | (F.col(ACTUAL) > F.col("forecast_upper"))
    return banded.withColumn(PREDICTED_ANOMALY, F.coalesce(outside, F.lit(False)))
