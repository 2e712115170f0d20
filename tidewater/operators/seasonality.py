"""Seasonality inference: Fourier orders by information criteria, and automatic settings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.calendar import add_time_features, fourier_terms
from tidewater.operators.regression import Gram, fit_ols, gram, squared_loss
from tidewater.schema import TIME, VALUE


@dataclass(frozen=True)
class Seasonality:
    """A seasonal component: calendar column, period in its unit, usual order, least days of history."""

    name: str
    column: str
    period: float
    order: int
    min_days: int


#: The usual components.
COMPONENTS = {s.name: s for s in (Seasonality("daily", "tod", 24.0, 12, 2), Seasonality("weekly", "tow", 7.0, 4, 14), Seasonality("monthly", "tom", 1.0, 2, 60), Seasonality("quarterly", "toq", 1.0, 5, 180), Seasonality("yearly", "ct1", 1.0, 15, 548))}


def detrend(df: DataFrame, method: str = "overall_average", column: str | None = None, keys: Sequence[str] = (), value: str = VALUE) -> DataFrame:
    """The value less the mean of all rows, or of rows that share ``column``."""
    by = [*keys, *([column] if column else [])]
    if method not in ("overall_average", "seasonal_average"):
        raise ValueError(f"unknown method {method}")
    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*by)))


def _sub(g: Gram, names: Sequence[str]) -> Gram:
    at = [g.names.index(n) for n in names]
    return Gram(list(names), g.xx[np.ix_(at, at)], g.xy[at], g.yy, g.n, g.rows)


def order_criteria(df: DataFrame, component: Seasonality, max_order: int, ts: str = TIME, value: str = VALUE) -> list[dict]:
    """AIC and BIC of every order up to ``max_order``, from one pass over the rows: lower orders use parts of one matrix."""
    base = add_time_features(df.filter(F.col(value).isNotNull()), [component.column], ts)
    terms = fourier_terms(component.column, component.period, max_order, component.name)
    g = gram(base, {"Intercept": F.lit(1.0)} | terms, F.col(value))
    out = []
    for k in range(1, max_order + 1):
        part = _sub(g, ["Intercept", *list(terms)[: 2 * k]])
        mse = max(1e-300, squared_loss(part, fit_ols(part).beta) / part.rows)
        out.append({"order": k, "aic": 4 * k + part.rows * math.log(mse), "bic": math.log(part.rows) * 2 * k + part.rows * math.log(mse)})
    return out


def infer_order(df: DataFrame, component: Seasonality, max_order: int, criterion: str = "bic", tolerance: float = 0.0, ts: str = TIME, value: str = VALUE) -> int:
    """The smallest order within min + |min| * tolerance."""
    rows = order_criteria(df, component, max_order, ts, value)
    best = min(r[criterion] for r in rows)
    return next(r["order"] for r in rows if r[criterion] <= best + abs(best) * tolerance)


def auto_orders(days: float, seasonalities: Sequence[str], given: dict[str, int | str] | None = None) -> dict[str, int]:
    """Orders of the components that the history is long enough for; "auto" and missing are the usual order, 0 is off."""
    out = {}
    for name in seasonalities:
        want = (given or {}).get(name, "auto")
        c = COMPONENTS[name]
        if want in ("auto", True):
            out[name] = c.order if days >= c.min_days else 0
        else:
            out[name] = int(want or 0)
    return {k: v for k, v in out.items() if v}


def drop_collinear(names: Sequence[str]) -> list[str]:
    """Fourier terms without those that repeat others: quarterly k is yearly 4k, monthly yearly 12k or quarterly 3k; weekly cosines of
    orders 4 to 7 and all above 7 repeat lower ones on daily data."""
    import re

    kept = set(names)
    has = lambda f, k, s: any(re.fullmatch(rf"{f}{k}_\w+_{s}", n) for n in names)
    for n in names:
        m = re.fullmatch(r"(sin|cos)(\d+)_\w+?_(\w+)", n)
        if not m:
            continue
        f, k, s = m[1], int(m[2]), m[3]
        if s == "quarterly" and has(f, 4 * k, "yearly"):
            kept.discard(n)
        if s == "monthly" and (has(f, 12 * k, "yearly") or has(f, 3 * k, "quarterly")):
            kept.discard(n)
        if s == "weekly" and (k > 7 or (f == "cos" and 4 <= k <= 7)):
            kept.discard(n)
    return [n for n in names if n in kept]
