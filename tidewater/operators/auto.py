"""Automatic settings from the data: growth, seasonality orders, holidays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.calendar import continuous_year
from tidewater.operators import changepoints, events, seasonality
from tidewater.operators.regression import fit_ols, gram, squared_loss
from tidewater.operators.timegrid import history_days, resample
from tidewater.schema import TIME, VALUE


def auto_seasonality(df: DataFrame, names: Sequence[str] = ("yearly", "quarterly", "monthly", "weekly", "daily"), criterion: str = "bic", ts: str = TIME, value: str = VALUE) -> dict[str, int]:
    """Orders by criterion, of components that the history covers and the spacing can show."""
    h = history_days(df.filter(F.col(value).isNotNull()), ts=ts).first()
    out = {}
    for name in names:
        c = seasonality.COMPONENTS[name]
        if h.num_training_days < c.min_days or (name == "daily" and h.period >= 86400) or (name == "weekly" and h.period > 86400):
            continue
        best = seasonality.infer_order(seasonality.detrend(df, "overall_average", value=value), c, c.order, criterion, ts=ts, value=value)
        out[name] = best
    return out


def auto_growth(df: DataFrame, ts: str = TIME, value: str = VALUE, horizon_days: float = 0) -> dict:
    """The growth term whose straight fit leaves least, and changepoints by the history's length."""
    known = df.filter(F.col(value).isNotNull())
    h = history_days(known, ts=ts).first()
    first = known.agg(F.min(continuous_year(F.col(ts))).alias("a")).first().a
    based = known.withColumn("_t", continuous_year(F.col(ts)) - F.lit(first))
    shapes = {"ct1": F.col("_t"), "ct_sqrt": F.sqrt(F.greatest("_t", F.lit(0.0))), "ct2": F.col("_t") * F.col("_t")}
    loss = {}
    for name, c in shapes.items():
        g = gram(based, {"Intercept": F.lit(1.0), name: c}, F.col(value))
        loss[name] = squared_loss(g, fit_ols(g).beta)
    params = changepoints.auto_parameters(h.data_points, h.period / 86400, 8)
    found = [] if params["potential"] < 2 else changepoints.trend_changepoints(known, min(20, params["potential"]), 4, params["freq"], 0.6, params["min_distance_days"], max(horizon_days, h.num_training_days / 20), ts, value)
    return {"growth": min(loss, key=lambda k: (loss[k], k)), "changepoints": found}


def auto_holidays(df: DataFrame, countries: Sequence[str], before: int = 1, after: int = 1, ts: str = TIME, value: str = VALUE) -> DataFrame:
    """Holidays and neighbouring days with an effect, in groups of like size: (event_key, avg_score, group)."""
    daily = resample(df, "D", {value: F.avg(value)}, (), ts)
    span = daily.agg(F.year(F.min(TIME)).alias("a"), F.year(F.max(TIME)).alias("b")).first()
    table = events.holidays(df.sparkSession, countries, span.a, span.b)
    keyed = table.select(F.regexp_replace("event_name", r"[^0-9A-Za-z_]", "_").alias("event_key"), "date", F.lit("event").alias("event_name")).distinct()
    wide = events.expand_with_suffix(keyed, events_suffix, before, after)
    scores = events.prune_events(events.average_scores(events.holiday_scores(daily, wide, ts=TIME, value=value)))
    n = min(5, scores.count())
    return events.group_events(scores, n) if n > 1 else scores.withColumn("group", F.lit(0))


def events_suffix(date):
    from tidewater.functions.calendar import weekday_weekend_suffix

    return weekday_weekend_suffix(date)
