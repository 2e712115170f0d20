"""Names of columns, feature categories and frequencies.

The column names and categories are fixed values: results are told apart by them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME, VALUE, KEY = "ts", "y", "series"
ACTUAL, FORECAST, LOWER, UPPER, NULL_FORECAST = "actual", "forecast", "forecast_lower", "forecast_upper", "forecast_null"
QUANTILES, ERR_STD = "quantile_summary", "err_std"
ANOMALY, PREDICTED_ANOMALY = "is_anomaly", "is_anomaly_predicted"
START, END, ADJUSTMENT = "start_time", "end_time", "adjustment_delta"

#: Feature categories by column name.
TREND_REGEX = r"changepoint\d|ct\d|ct_|cp\d"
SEASONALITY_REGEX = r"sin\d|cos\d"
EVENT_REGEX = r"events_"
LAG_REGEX = r"_lag\d|_avglag_\d"

DAY_SECONDS = 86400


@dataclass(frozen=True)
class Frequency:
    """A regular spacing: its interval, seconds per period (months are 30 days, quarters 90, years 365) and usual horizon."""

    name: str
    interval: str
    seconds: int
    horizon: int
    seasonalities: tuple[str, ...]


#: Simple frequencies, finest first.
FREQUENCIES = {
    f.name: f
    for f in (
        Frequency("MINUTE", "1 minute", 60, 60, ("daily", "weekly", "monthly", "quarterly", "yearly")),
        Frequency("HOUR", "1 hour", 3600, 24, ("daily", "weekly", "monthly", "quarterly", "yearly")),
        Frequency("DAY", "1 day", 86400, 30, ("weekly", "monthly", "quarterly", "yearly")),
        Frequency("WEEK", "7 days", 7 * 86400, 12, ("monthly", "quarterly", "yearly")),
        Frequency("MONTH", "1 month", 30 * 86400, 12, ("quarterly", "yearly")),
        Frequency("QUARTER", "3 months", 90 * 86400, 12, ("yearly",)),
        Frequency("YEAR", "1 year", 365 * 86400, 2, ()),
        Frequency("MULTIYEAR", "2 years", 2 * 365 * 86400, 2, ()),
    )
}


def simple_frequency(seconds: float) -> Frequency:
    """The frequency that a period of so many seconds counts as: the first whose bound it doesn't exceed."""
    bounds = {"MINUTE": 60 * 10.05, "HOUR": 3600 * 1.05, "DAY": 86400 * 1.05, "WEEK": 7 * 86400 * 2.05, "MONTH": 30 * 86400 * 2.05, "QUARTER": 90 * 86400 * 1.05, "YEAR": 365 * 86400 * 1.01}
    return FREQUENCIES[next((k for k, most in bounds.items() if seconds <= most), "MULTIYEAR")]


def finite(col: Column | str) -> Column:
    """NaN and infinities as null; the rest as double."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ingest(df: DataFrame, time_col: str, value_col: str, key_cols: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Rename to (keys, ts, y, extra), the value with NaN and infinities as null."""
    missing = {time_col, value_col, *(key_cols or []), *(extra or [])} - set(df.columns)
    if missing:
        raise ValueError(f"columns not found: {sorted(missing)}")
    return df.select(*(key_cols or []), F.col(time_col).cast("timestamp_ntz").alias(TIME), finite(value_col).alias(VALUE), *(extra or []))


def columns_like(columns: list[str], include: str, exclude: str | None = None) -> list[str]:
    """Column names that match ``include`` anywhere and don't match ``exclude``."""
    return [c for c in columns if re.search(include, c) and not (exclude and re.search(exclude, c))]


def split_by_patterns(names: list[str], patterns: dict[str, str]) -> tuple[dict[str, list[str]], list[str]]:
    """Names by the first pattern that matches their start, and the rest."""
    left, out = list(names), {}
    for group, pattern in patterns.items():
        out[group] = [n for n in left if re.match(pattern, n)]
        left = [n for n in left if n not in out[group]]
    return out, left


def columns_of_type(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Columns whose simple type name (before any bracket) is among ``include`` (empty: any) and not among ``exclude``."""
    kinds = [(c, t.split("(")[0].split("<")[0]) for c, t in df.dtypes]
    return [c for c, t in kinds if (not include or t in include) and t not in exclude]


def reorder(df: DataFrame, rank: dict[str, float]) -> DataFrame:
    """Columns by ascending rank; those without one come last, in the order they had."""
    return df.select(*sorted(df.columns, key=lambda c: rank.get(c, float("inf"))))
