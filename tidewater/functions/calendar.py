"""Calendar features, daylight saving, Fourier terms and growth terms as column expressions over a timestamp_ntz column."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.schema import TIME


def _pad(c: Column, n: int = 2) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def is_leap(ts: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31))) == 366


def time_of_day(ts: Column) -> Column:
    """Hours since midnight as double; parts of seconds don't count."""
    return F.hour(ts) + F.minute(ts) / 60 + F.floor(F.second(ts)) / 3600


def continuous_year(ts: Column) -> Column:
    """The year with the elapsed share of it."""
    return F.year(ts) + (F.dayofyear(ts) - 1 + time_of_day(ts) / 24) / F.when(is_leap(ts), 366.0).otherwise(365.0)


def signed_power(x: Column, y: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(y))


def logistic(x: Column, growth_rate: float = 1.0, capacity: float = 1.0, floor: float = 0.0, inflection: float = 0.0) -> Column:
    return floor + capacity / (1 + F.exp(-growth_rate * (x - inflection)))


def _nth_sunday(year: Column, month: int, nth: int) -> Column:
    """The nth Sunday of a month; nth -1 for its last."""
    if nth > 0:
        first = F.make_date(year, F.lit(month), F.lit(1))
        return F.date_add(first, (6 - F.weekday(first)) % 7 + 7 * (nth - 1))
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, (F.weekday(last) + 1) % 7)


def _at_hour(date: Column, hour: int) -> Column:
    return F.make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), F.lit(hour), F.lit(0), F.lit(0))


def is_dst(ts: Column, zone: str = "us") -> Column:
    """Daylight saving, both ends inclusive. ``us``: second Sunday of March to first of November, 2:00, years 2007 to
    2079. ``eu``: last Sundays of March and October, 1:00, years 1996 to 2079. Other years: false."""
    year = F.year(ts)
    if zone == "us":
        start, end, first = _at_hour(_nth_sunday(year, 3, 2), 2), _at_hour(_nth_sunday(year, 11, 1), 2), 2007
    elif zone == "eu":
        start, end, first = _at_hour(_nth_sunday(year, 3, -1), 1), _at_hour(_nth_sunday(year, 10, -1), 1), 1996
    else:
        raise ValueError(f"unknown zone {zone}")
    return year.between(first, 2079) & ts.between(start, end)


def time_features(ts: Column | str = TIME, origin: float | Column = 0.0, names: Sequence[str] | None = None) -> dict[str, Column]:
    """Calendar features by name (all by default); ``origin`` is the decimal year at which trends are 0."""
    t = F.col(ts) if isinstance(ts, str) else ts
    # every feature is a recipe: only those asked for become expressions
    leap, tod, doy = (lambda: is_leap(t)), (lambda: time_of_day(t)), (lambda: F.dayofyear(t))
    year, dow = (lambda: F.year(t)), (lambda: F.weekday(t) + 1)
    quarter_start = lambda: F.to_date(F.date_trunc("QUARTER", t))
    quarter_length = lambda: F.date_diff(F.add_months(quarter_start(), 3), quarter_start())
    month_length = lambda: F.dayofmonth(F.last_day(t))
    dom, doq = (lambda: F.dayofmonth(t)), (lambda: F.date_diff(F.to_date(t), quarter_start()) + 1)
    woy, year_iso = (lambda: F.weekofyear(t)), (lambda: F.extract(F.lit("YEAROFWEEK"), t))
    monday_week = lambda: F.floor((doy() + 7 - dow()) / 7)
    str_dow = lambda: F.concat(dow().cast("string"), F.lit("-"), F.date_format(t, "EEE"))
    ct = lambda: continuous_year(t) - origin
    frozen = lambda: F.when(leap() & (doy() > 60), 1).otherwise(0)
    every = {
        "datetime": lambda: t,
        "date": lambda: F.to_date(t),
        "year": year,
        "year_length": lambda: F.when(leap(), 366.0).otherwise(365.0),
        "quarter": lambda: F.quarter(t),
        "quarter_start": quarter_start,
        "quarter_length": quarter_length,
        "month": lambda: F.month(t),
        "month_length": month_length,
        "woy": woy,
        "doy": doy,
        "doq": doq,
        "dom": dom,
        "dow": dow,
        "str_dow": str_dow,
        "str_doy": lambda: F.date_format(t, "yyyy-MM-dd"),
        "hour": lambda: F.hour(t),
        "minute": lambda: F.minute(t),
        "second": lambda: F.floor(F.second(t)).cast("int"),
        "year_quarter": lambda: F.concat_ws("-", year().cast("string"), F.quarter(t).cast("string")),
        "year_month": lambda: F.date_format(t, "yyyy-MM"),
        "year_woy": lambda: F.concat_ws("_", year().cast("string"), _pad(woy())),
        "month_dom": lambda: F.date_format(t, "MM/dd"),
        "year_woy_dow": lambda: F.concat_ws("_", year().cast("string"), _pad(woy()), dow().cast("string")),
        "woy_dow": lambda: F.concat_ws("_", _pad(monday_week()), dow().cast("string")),
        "dow_hr": lambda: F.concat_ws("_", dow().cast("string"), F.date_format(t, "HH")),
        "dow_hr_min": lambda: F.concat_ws("_", dow().cast("string"), F.date_format(t, "HH"), F.date_format(t, "mm")),
        "year_iso": year_iso,
        "year_woy_iso": lambda: F.concat_ws("_", year_iso().cast("string"), _pad(woy())),
        "year_woy_dow_iso": lambda: F.concat_ws("_", year_iso().cast("string"), _pad(woy()), dow().cast("string")),
        "tod": tod,
        "tow": lambda: dow() - 1 + tod() / 24,
        "tom": lambda: (dom() - 1 + tod() / 24) / month_length(),
        "toq": lambda: (doq() - 1 + tod() / 24) / quarter_length(),
        "toy": lambda: (doy() - 1 - frozen() + tod() / 24 * F.when(leap() & (doy() == 60), 0).otherwise(1)) / 365.0,
        "conti_year": lambda: continuous_year(t),
        "is_weekend": lambda: dow().isin(6, 7),
        "dow_grouped": lambda: F.when(dow() <= 4, "1234-MTuWTh").otherwise(str_dow()),
        "ct1": ct,
        "ct2": lambda: signed_power(ct(), 2.0),
        "ct3": lambda: signed_power(ct(), 3.0),
        "ct_sqrt": lambda: signed_power(ct(), 0.5),
        "ct_root3": lambda: signed_power(ct(), 1 / 3),
        "us_dst": lambda: is_dst(t, "us"),
        "eu_dst": lambda: is_dst(t, "eu"),
    }
    return {k: every[k]() for k in (names or every)}


def add_time_features(df: DataFrame, names: Sequence[str] | None = None, ts: str = TIME, origin: float | Column = 0.0) -> DataFrame:
    """Append calendar features (all by default) in one projection."""
    return df.withColumns(time_features(ts, origin, names))


def fourier_name(k: int, col: str, function: str, seasonality: str | None = None) -> str:
    return f"{function}{k}_{col}" + (f"_{seasonality}" if seasonality else "")


def fourier_terms(col: str, period: float, order: int, seasonality: str | None = None, base: Column | None = None) -> dict[str, Column]:
    """sin and cos of 2 pi k x / period for k = 1 .. order."""
    x = F.col(col) if base is None else base
    out = {}
    for k in range(1, order + 1):
        angle = x * (2 * math.pi * k / period)
        out[fourier_name(k, col, "sin", seasonality)] = F.sin(angle)
        out[fourier_name(k, col, "cos", seasonality)] = F.cos(angle)
    return out


def fourier_multi(cols: Sequence[str], periods: Sequence[float], orders: Sequence[int], seasonalities: Sequence[str | None] | None = None) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for c, p, n, s in zip(cols, periods, orders, seasonalities or [None] * len(cols), strict=True):
        out |= fourier_terms(c, p, n, s)
    return out


def changepoint_terms(values: Sequence[float], ct: Column, growth: Callable[[Column], Column] = lambda x: x, names: Sequence[str] | None = None) -> dict[str, Column]:
    """Growth since each changepoint, 0 before it."""
    return {(names[k] if names else f"changepoint{k}"): F.when(ct >= v, growth(ct - F.lit(v))).otherwise(F.lit(0.0)) for k, v in enumerate(values)}


def changepoint_suffixes(dates: Sequence) -> list[str]:
    """Name suffix of each date: as much of the time as isn't zero."""
    out = []
    for d in dates:
        form = "_%Y_%m_%d_%H" + ("_%M" if d.minute or d.second else "") + ("_%S" if d.second else "")
        out.append(d.strftime(form))
    return out


def weekday_weekend_suffix(date: Column) -> Column:
    return F.when(F.weekday(date) >= 5, "_WE").otherwise("_WD")


def grouped_dow_suffix(date: Column) -> Column:
    dow = F.weekday(date) + 1
    return F.when(dow == 6, "_Sat").when(dow == 7, "_Sun").when(dow.isin(1, 5), "_Mon/Fri").otherwise("_WD")


def utc_offset_seconds(ts: Column, zone: str) -> Column:
    """Seconds by which local time in ``zone`` is ahead of UTC at a local time."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)
    return F.timestamp_diff("SECOND", utc, ts)


def zone_dst(ts: Column, zone: str) -> Column:
    """Whether a local time falls into daylight saving of a zone of the tz database: its offset is above the smaller of
    those on the first of January and of July."""
    january, july = (F.make_timestamp_ntz(F.year(ts), F.lit(m), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) for m in (1, 7))
    return utc_offset_seconds(ts, zone) > F.least(utc_offset_seconds(january, zone), utc_offset_seconds(july, zone))


def round_significant(x: Column, digits: int = 3) -> Column:
    """Rounded to significant digits; digits before the point all stay."""
    size = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x))) + 1)
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(digits) - size, F.lit(0)).cast("double"))
    return F.round(x * scale) / scale
