"""Generalised linear models with errors of their coefficients, and coefficient tables by the kind of their terms.

A fit is a sequence of weighted least squares: each round adds up one weighted matrix over the rows (see ``gram``), and the
last matrix is the information that errors come from. No row leaves the executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.regression import Fit, gram, linear
from tidewater.schema import EVENT_REGEX, LAG_REGEX, SEASONALITY_REGEX, TREND_REGEX

#: family: (mean of the linear predictor, its slope, variance of the mean, whether the dispersion is 1)
FAMILIES = {
    "poisson": (F.exp, lambda mu: mu, lambda mu: mu, True),
    "gamma": (F.exp, lambda mu: mu, lambda mu: mu * mu, False),
    "binomial": (lambda eta: 1 / (1 + F.exp(-eta)), lambda mu: mu * (1 - mu), lambda mu: mu * (1 - mu), True),
    "gaussian": (lambda eta: eta, lambda mu: F.lit(1.0), lambda mu: F.lit(1.0), False),
}


@dataclass
class GlmFit(Fit):
    """Coefficients with the information matrix, the dispersion and whether the rounds came to rest."""

    family: str = "gaussian"
    information: np.ndarray | None = None
    dispersion: float = 1.0
    rows: int = 0
    converged: bool = False


def fit_glm(df: DataFrame, columns: dict[str, Column], response: Column, family: str = "gamma", rounds: int = 50, tol: float = 1e-10) -> GlmFit:
    """Maximum likelihood with log link (poisson, gamma), logit (binomial) or identity; starts from the response itself.

    ``converged`` says whether coefficients moved by less than ``tol``, relatively, within ``rounds``.
    """
    mean, slope, variance, fixed = FAMILIES[family]
    y = response.cast("double")
    start = {"poisson": y + 0.1, "gamma": F.greatest(y, F.lit(1e-12)), "binomial": (y + 0.5) / 2, "gaussian": y}[family]
    eta = {"poisson": F.log(start), "gamma": F.log(start), "binomial": F.log(start / (1 - start)), "gaussian": y}[family]
    beta, converged = None, False
    for _ in range(rounds):
        mu = mean(eta)
        d = slope(mu)
        g = gram(df, columns, eta + (y - mu) / d, d * d / variance(mu))
        new = np.linalg.lstsq(g.xx, g.xy, rcond=None)[0]
        converged = beta is not None and bool(np.all(np.abs(new - beta) <= tol * np.maximum(1.0, np.abs(beta))))
        beta = new
        eta = linear(columns, dict(zip(columns, beta, strict=True)))
        if converged:
            break
    dispersion = 1.0
    if not fixed:
        mu = mean(eta)
        complete = df.filter(y.isNotNull() & ~F.greatest(*[c.isNull() for c in columns.values()], F.lit(False)))
        dispersion = complete.agg(F.sum(F.pow(y - mu, F.lit(2.0)) / variance(mu))).first()[0] / max(1, g.rows - np.linalg.matrix_rank(g.xx))
    return GlmFit(list(columns), beta, family=family, information=g.xx, dispersion=float(dispersion), rows=g.rows, converged=converged)


def glm_summary(fit: GlmFit, coverage: float = 0.95) -> list[dict]:
    """Coefficient rows: estimate, standard error, z, p (normal) and interval."""
    se = np.sqrt(np.maximum(0.0, np.diag(np.linalg.pinv(fit.information, hermitian=True)) * fit.dispersion))
    far, rows = NormalDist().inv_cdf((1 + coverage) / 2), []
    for name, b, s in zip(fit.names, fit.beta.tolist(), se.tolist(), strict=True):
        z = b / s if s else float("nan")
        rows.append({"term": name, "estimate": b, "std_err": s, "z": z, "p": math.erfc(abs(z) / math.sqrt(2)) if s else float("nan"), "lower": b - far * s, "upper": b + far * s})
    return rows


#: Kinds of terms by name; a term may be of several.
_KINDS = {"is_intercept": "Intercept", "is_event": EVENT_REGEX, "is_trend": TREND_REGEX, "is_seasonality": SEASONALITY_REGEX, "is_lag": LAG_REGEX, "is_interaction": ":"}


def with_kinds(coefficients: DataFrame, regressors: Sequence[str] = (), time_features: Sequence[str] = (), term: str = "term") -> DataFrame:
    """Adds is_intercept, is_event, is_trend, is_seasonality, is_lag, is_interaction, is_regressor and is_time by the term's name.

    A part of an interaction makes the whole term of its kind; terms of regressors are of no other kind but interaction.
    Trend is growth outside of seasonal terms.
    """
    name = F.col(term)
    parts = F.split(name, ":")
    bare = lambda p: F.regexp_extract(p, r"^(?:C\()?([^\[\)]*)", 1)
    own = F.exists(parts, lambda p: bare(p).isin(list(regressors))) if regressors else F.lit(False)
    seasonal = lambda p: p.rlike(SEASONALITY_REGEX)
    flags = {k: name.rlike(p) for k, p in _KINDS.items()}
    flags["is_trend"] = F.exists(parts, lambda p: p.rlike(TREND_REGEX) & ~seasonal(p))
    flags["is_time"] = F.exists(parts, lambda p: bare(p).isin(list(time_features)) & ~seasonal(p)) if time_features else F.lit(False)
    out = {k: (c if k == "is_interaction" else c & ~own) for k, c in flags.items()} | {"is_regressor": own}
    return coefficients.withColumns(out)


def filter_terms(coefficients: DataFrame, **kinds: bool) -> DataFrame:
    """Rows of ``with_kinds`` by flags, such as ``is_trend=True, is_interaction=False``."""
    unknown = set(kinds) - {c for c in coefficients.columns if c.startswith("is_")}
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    for k, wanted in kinds.items():
        coefficients = coefficients.filter(F.col(k) == F.lit(wanted))
    return coefficients
