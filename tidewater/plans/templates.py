"""Named templates: settings by name, the grammar of composed names, and the choice by data."""

from __future__ import annotations

import itertools
import re

#: Fourier orders (yearly, quarterly, monthly, weekly, daily) by frequency and strength.
SEASONALITY_ORDERS = {
    "HOURLY": {"LT": (8, 0, 0, 3, 5), "NM": (15, 0, 0, 4, 8), "HV": (25, 0, 0, 6, 12), "LTQM": (8, 2, 2, 3, 5), "NMQM": (15, 3, 3, 4, 8), "HVQM": (25, 4, 4, 6, 12), "NONE": (0, 0, 0, 0, 0)},
    "DAILY": {"LT": (8, 0, 0, 3, 0), "NM": (15, 0, 0, 3, 0), "HV": (25, 0, 0, 4, 0), "LTQM": (8, 3, 2, 3, 0), "NMQM": (15, 4, 4, 3, 0), "HVQM": (25, 6, 4, 4, 0), "NONE": (0, 0, 0, 0, 0)},
    "WEEKLY": {"LT": (8, 0, 0, 0, 0), "NM": (15, 0, 0, 0, 0), "HV": (25, 0, 0, 0, 0), "LTQM": (8, 2, 2, 0, 0), "NMQM": (15, 3, 3, 0, 0), "HVQM": (25, 4, 4, 0, 0), "NONE": (0, 0, 0, 0, 0)},
}
#: Strengths of changepoint regularisation.
CHANGEPOINT_STRENGTH = {"LT": 0.6, "NM": 0.5, "HV": 0.3}
#: Parts of a composed name and their defaults; the first letters are keys.
PARTS = {"SEAS": "LT", "GR": "LINEAR", "CP": "NONE", "HOL": "NONE", "FEASET": "OFF", "ALGO": "LINEAR", "AR": "OFF", "DSI": "AUTO", "WSI": "AUTO"}
_HOLIDAY_DAYS = {"NONE": None, "SP1": 1, "SP2": 2, "SP4": 4, "TG": 3}
_ALGORITHMS = {"LINEAR": "linear", "RIDGE": "ridge", "SGD": "sgd", "LASSO": "lasso"}
_SEASONS = ("yearly", "quarterly", "monthly", "weekly", "daily")


def parse_name(name: str) -> dict:
    """Settings of a composed name such as DAILY_SEAS_NM_GR_LINEAR_CP_LT_HOL_SP2_FEASET_AUTO_ALGO_RIDGE_AR_AUTO."""
    m = re.fullmatch(r"(HOURLY|DAILY|WEEKLY)((?:_[A-Z0-9]+)*)", name)
    if not m:
        raise ValueError(f"not a template name: {name}")
    words, parts, k = [w for w in m[2].split("_") if w], dict(PARTS), 0
    while k < len(words):
        if words[k] not in PARTS or k + 1 >= len(words):
            raise ValueError(f"can't read {words[k]} in {name}")
        parts[words[k]] = words[k + 1]
        k += 2
    orders = SEASONALITY_ORDERS[m[1]].get(parts["SEAS"])
    if orders is None or parts["HOL"] not in _HOLIDAY_DAYS or parts["ALGO"] not in _ALGORITHMS or parts["CP"] not in (*CHANGEPOINT_STRENGTH, "NONE"):
        raise ValueError(f"unknown value in {name}")
    freq = "D" if m[1] == "HOURLY" else "7D"
    return {
        "frequency": m[1],
        "growth": {"LINEAR": "ct1", "NONE": "", "QUADRATIC": "ct2", "SQRT": "ct_sqrt"}.get(parts["GR"], "ct1"),
        "seasonality": {s: o for s, o in zip(_SEASONS, orders, strict=True) if o},
        "changepoints": None if parts["CP"] == "NONE" else {"method": "auto", "strength": CHANGEPOINT_STRENGTH[parts["CP"]], "freq": freq},
        "holiday_days": _HOLIDAY_DAYS[parts["HOL"]],
        "holidays_together": parts["HOL"] == "TG",
        "feature_sets": parts["FEASET"],
        "algorithm": _ALGORITHMS[parts["ALGO"]],
        "autoreg": parts["AR"] == "AUTO",
    }


#: Templates by name: one composed name, or several to choose from.
TEMPLATES: dict[str, list[str]] = {
    "HOURLY_1": ["HOURLY_SEAS_NM_GR_LINEAR_CP_LT_HOL_SP4_FEASET_AUTO_ALGO_RIDGE_AR_AUTO"],
    "HOURLY_24": ["HOURLY_SEAS_NM_GR_LINEAR_CP_NM_HOL_SP4_FEASET_AUTO_ALGO_RIDGE_AR_AUTO", "HOURLY_SEAS_LT_GR_LINEAR_CP_NONE_HOL_SP1_FEASET_AUTO_ALGO_RIDGE_AR_AUTO"],
    "HOURLY_168": ["HOURLY_SEAS_NM_GR_LINEAR_CP_LT_HOL_SP4_FEASET_OFF_ALGO_RIDGE_AR_OFF", "HOURLY_SEAS_NMQM_GR_LINEAR_CP_LT_HOL_SP4_FEASET_AUTO_ALGO_RIDGE_AR_OFF"],
    "HOURLY_336": ["HOURLY_SEAS_LT_GR_LINEAR_CP_LT_HOL_SP2_FEASET_AUTO_ALGO_RIDGE_AR_OFF"],
    "DAILY_1": ["DAILY_SEAS_NM_GR_LINEAR_CP_LT_HOL_SP2_FEASET_AUTO_ALGO_RIDGE_AR_AUTO", "DAILY_SEAS_NM_GR_LINEAR_CP_NONE_HOL_SP1_FEASET_AUTO_ALGO_LINEAR_AR_AUTO"],
    "DAILY_90": ["DAILY_SEAS_LTQM_GR_LINEAR_CP_LT_HOL_SP2_FEASET_AUTO_ALGO_LINEAR_AR_OFF", "DAILY_SEAS_NM_GR_LINEAR_CP_LT_HOL_SP2_FEASET_AUTO_ALGO_RIDGE_AR_OFF"],
    "WEEKLY": ["WEEKLY_SEAS_NM_GR_LINEAR_CP_NONE_HOL_NONE_FEASET_OFF_ALGO_LINEAR_AR_OFF", "WEEKLY_SEAS_LT_GR_LINEAR_CP_LT_HOL_NONE_FEASET_OFF_ALGO_RIDGE_AR_OFF"],
    "MONTHLY": ["WEEKLY_SEAS_LT_GR_LINEAR_CP_NONE_HOL_NONE_FEASET_OFF_ALGO_LINEAR_AR_OFF"],
    "DEFAULT": ["DAILY_SEAS_NM_GR_LINEAR_CP_LT_HOL_SP2_FEASET_AUTO_ALGO_RIDGE_AR_AUTO"],
    "EMPTY": ["DAILY_SEAS_NONE_GR_NONE_CP_NONE_HOL_NONE_FEASET_OFF_ALGO_LINEAR_AR_OFF"],
}


def auto_template(freq: str | None, horizon: int, n_splits: int, cv_horizon: int, cv_max_splits: int | None = None, default: str = "DEFAULT") -> list[str]:
    """Names to compare, by frequency and horizon; only the first unless there are enough splits to tell them apart."""
    name = default
    if freq and freq in ("H", "h"):
        name = next((n for most, n in ((1, "HOURLY_1"), (48, "HOURLY_24"), (192, "HOURLY_168"), (504, "HOURLY_336")) if horizon <= most), default)
    elif freq == "D":
        name = "DAILY_1" if horizon <= 7 else "DAILY_90" if horizon >= 90 else default
    elif freq and freq.startswith("W"):
        name = "WEEKLY"
    elif freq and freq[0] == "M":
        name = "MONTHLY"
    enough = n_splits >= 5 and n_splits * cv_horizon >= 30 and cv_max_splits != 0
    return TEMPLATES[name] if enough else TEMPLATES[name][:1]


def feature_sets(seconds: float, days: float) -> list[str]:
    """Formula terms of feature sets that the data are long enough for."""
    terms: list[str] = []
    if seconds <= 3600 and days >= 30:
        terms += ["C(dow_hr)", "is_weekend:hour"]
    if seconds <= 86400:
        terms.append("C(str_dow)")
        if days >= 30:
            terms.append("is_weekend:ct1")
        if days >= 90:
            terms.append("C(str_dow):ct1")
    return terms


def expand(names: list[str], grid: dict[str, list] | None = None) -> list[dict]:
    """Settings of all names, each with all combinations of the grid on top."""
    choices = list(itertools.product(*(grid or {}).values()))
    return [parse_name(n) | dict(zip((grid or {}).keys(), c, strict=True)) for n in names for c in choices]
