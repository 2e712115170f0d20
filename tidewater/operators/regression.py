"""Regression over DataFrames: formulas to design columns, fits from Gram matrices, prediction, breakdown and inference.

A fit needs sums of products of its columns only. Spark adds these up (one row per partition and series, in numpy);
what reaches the driver, or one task per series, is a p x p matrix, whatever the number of rows. All penalised and
iterative fits below run on that matrix.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- formulas

_TERM = re.compile(r"C\(\s*(?:Q\(\s*['\"](?P<q1>.+?)['\"]\s*\)|(?P<n1>\w+))\s*(?:,\s*levels\s*=\s*(?P<levels>\[.*?\]))?\s*\)|Q\(\s*['\"](?P<q2>.+?)['\"]\s*\)|(?P<n2>\w+)")


@dataclass
class Factor:
    """A column of a term: numeric, or categorical with its levels."""

    name: str
    categorical: bool = False
    levels: list | None = None


def parse_formula(formula: str) -> tuple[str, list[list[Factor]], bool]:
    """(response, terms, intercept) of "y ~ a + C(b, levels=[...]) + a:Q('c d')"; "0" or "-1" drops the intercept."""
    left, right = formula.split("~", 1)
    terms, intercept = [], True
    depth, part, parts = 0, "", []
    for ch in right:
        depth += (ch in "([") - (ch in ")]")
        if ch == "+" and not depth:
            parts.append(part)
            part = ""
        elif ch == "-" and not depth:
            parts.append(part)
            part = "-"
        else:
            part += ch
    for p in (x.strip() for x in [*parts, part]):
        if p in ("0", "-1", "- 1"):
            intercept = False
        elif p and p != "1":
            factors = []
            for f in re.split(r":(?![^\[(]*[\])])", p):
                m = _TERM.fullmatch(f.strip())
                if not m:
                    raise ValueError(f"can't read the term {f!r}")
                if m["q1"] or m["n1"]:
                    factors.append(Factor(m["q1"] or m["n1"], True, json.loads(m["levels"].replace("'", '"')) if m["levels"] else None))
                else:
                    factors.append(Factor(m["q2"] or m["n2"]))
            terms.append(factors)
    return left.strip(), terms, intercept


@dataclass
class Design:
    """Columns of a design matrix by name, as expressions over the data."""

    response: str
    columns: dict[str, Column]

    @property
    def names(self) -> list[str]:
        return list(self.columns)


def design(df: DataFrame, formula: str) -> Design:
    """Treatment coding: the first level of a categorical factor is the reference where a term without it (or the intercept)
    is in the model; levels are those given, or those of the data (all of them, including unseen-before ones at predict time, read as 0)."""
    response, terms, intercept = parse_formula(formula)
    types = dict(df.dtypes)
    wanted = {f.name for t in terms for f in t if f.levels is None and (f.categorical or types.get(f.name) in ("string", "boolean"))}
    seen = {}
    if wanted:
        row = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{n}`"))).alias(n) for n in sorted(wanted)]).first()
        seen = {n: row[n] for n in wanted}
    present = {frozenset()} if intercept else set()
    columns: dict[str, Column] = {"Intercept": F.lit(1.0)} if intercept else {}
    for term in terms:
        parts: list[list[tuple[str, Column]]] = []
        names = [f.name for f in term]
        for f in term:
            c = F.col(f"`{f.name}`")
            if f.name in seen or f.levels is not None:
                levels = f.levels if f.levels is not None else seen[f.name]
                full = frozenset(n for n in names if n != f.name) not in present
                mark = "" if full else "T."
                parts.append([(f"{f.name}[{mark}{x}]", F.coalesce((c == x).cast("double"), F.lit(0.0))) for x in (levels if full else levels[1:])])
            else:
                parts.append([(f.name, c.cast("double"))])
        for combo in itertools.product(*parts):
            product = combo[0][1]
            for _, c in combo[1:]:
                product = product * c
            columns[":".join(n for n, _ in combo)] = product
        present.add(frozenset(names))
    return Design(response, columns)


# ---- sums of products


@dataclass
class Gram:
    """Weighted sums over rows: X'X, X'y, y'y, sums of X and y, and the number of rows."""

    names: list[str]
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: float
    rows: int

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.names, self.xx - other.xx, self.xy - other.xy, self.yy - other.yy, self.n - other.n, self.rows - other.rows)


def _gram_of(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    ok = ~np.isnan(m).any(axis=1) & ~np.isnan(w)
    m, w = m[ok], w[ok]
    out = (m * w[:, None]).T @ m
    return np.concatenate([out.ravel(), [w.sum(), ok.sum()]])


def gram_table(df: DataFrame, columns: Sequence[Column], response: Column, weight: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, sums): one row per group; each partition hands on one matrix per group. Rows with a null don't count."""
    p = len(columns) + 1
    flat = df.select(*keys, F.array(*[c.cast("double") for c in columns], response.cast("double")).alias("_v"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            groups = b.groupby(list(keys), dropna=False) if keys else [((), b)]
            for k, g in groups:
                m = np.array([[np.nan if x is None else x for x in v] for v in g["_v"]], float).reshape(-1, p)
                s = _gram_of(m, g["_w"].to_numpy(float))
                k = k if isinstance(k, tuple) else (k,)
                sums[k] = sums[k] + s if k in sums else s
        yield pd.DataFrame([(*k, list(s)) for k, s in sums.items()], columns=[*keys, "sums"])

    kinds = dict(df.dtypes)
    partial = flat.mapInPandas(part, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "sums array<double>"]))
    # matrices add up entry by entry, a row of each at a time
    entries = partial.select(*keys, F.posexplode("sums").alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"))
    return entries.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias("sums"))


def gram_from(sums: Sequence[float], names: Sequence[str]) -> Gram:
    p = len(names)
    m = np.array(sums[:-2], float).reshape(p + 1, p + 1)
    return Gram(list(names), m[:p, :p], m[:p, p], float(m[p, p]), float(sums[-2]), int(sums[-1]))


def gram(df: DataFrame, columns: dict[str, Column], response: Column, weight: Column | None = None) -> Gram:
    row = gram_table(df, list(columns.values()), response, weight).first()
    if row is None:
        raise ValueError("no complete rows")
    return gram_from(row.sums, list(columns))


# ---- fits on a Gram matrix; the intercept (if any) is never penalised


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    alpha: float = 0.0
    params: dict = field(default_factory=dict)

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.names, self.beta.tolist(), strict=True))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cholesky where the matrix is well conditioned, else the pseudo-inverse."""
    if len(a) and np.log10(np.linalg.cond(a)) < 8:
        return np.linalg.solve(a, b)
    return np.linalg.pinv(a, hermitian=True) @ b


def _penalty(names: Sequence[str], alpha: float) -> np.ndarray:
    return np.diag([0.0 if n == "Intercept" else alpha for n in names])


def fit_ols(g: Gram) -> Fit:
    return Fit(g.names, _solve(g.xx, g.xy))


def fit_ridge(g: Gram, alpha: float = 1.0) -> Fit:
    return Fit(g.names, _solve(g.xx + _penalty(g.names, alpha), g.xy), alpha)


def squared_loss(g: Gram, beta: np.ndarray) -> float:
    return float(g.yy - 2 * beta @ g.xy + beta @ g.xx @ beta)


def fit_ridge_cv(total: Gram, folds: Sequence[Gram], alphas: Sequence[float] | None = None) -> Fit:
    """The penalty with the smallest squared loss on held-out folds; training sums are the total less the fold."""
    alphas = np.logspace(-5, 5, 30) if alphas is None else alphas
    losses = [sum(squared_loss(f, fit_ridge(total - f, a).beta) / max(1, f.n) for f in folds) for a in alphas]
    return fit_ridge(total, float(alphas[int(np.argmin(losses))]))


def _centred(g: Gram) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, float]:
    """Indices but the intercept, centred X'X / n and X'y / n, means of X and mean of y."""
    if "Intercept" not in g.names:
        return list(range(len(g.names))), g.xx / g.n, g.xy / g.n, np.zeros(len(g.names)), 0.0
    i = g.names.index("Intercept")
    rest = [k for k in range(len(g.names)) if k != i]
    mx, my = g.xx[i, rest] / g.n, g.xy[i] / g.n
    return rest, g.xx[np.ix_(rest, rest)] / g.n - np.outer(mx, mx), g.xy[rest] / g.n - mx * my, mx, my


def _from_centred(g: Gram, rest: list[int], b: np.ndarray, mx: np.ndarray, my: float) -> np.ndarray:
    beta = np.zeros(len(g.names))
    beta[rest] = b
    if "Intercept" in g.names:
        beta[g.names.index("Intercept")] = my - mx @ b
    return beta


def coordinate_descent(xx: np.ndarray, xy: np.ndarray, l1: np.ndarray, l2: np.ndarray, tol: float = 1e-9, rounds: int = 5000, start: np.ndarray | None = None) -> np.ndarray:
    """Minimiser of b'XXb / 2 - b'Xy + sum l1 |b| + sum l2 b^2 / 2 (sums already over n)."""
    b = np.zeros(len(xy)) if start is None else start.copy()
    grad = xx @ b - xy
    for _ in range(rounds):
        biggest = 0.0
        for k in range(len(b)):
            d = xx[k, k] + l2[k]
            if d <= 0:
                continue
            z = b[k] * xx[k, k] - grad[k]
            new = math.copysign(max(abs(z) - l1[k], 0.0), z) / d
            step = new - b[k]
            if step:
                grad += xx[:, k] * step
                b[k] = new
                biggest = max(biggest, abs(step) * math.sqrt(xx[k, k]))
        if biggest < tol * max(1.0, np.sqrt(np.abs(xy).max(initial=0))):
            break
    return b


def fit_elastic_net(g: Gram, alpha: float = 1.0, l1_ratio: float = 0.5) -> Fit:
    rest, xx, xy, mx, my = _centred(g)
    n = len(rest)
    b = coordinate_descent(xx, xy, np.full(n, alpha * l1_ratio), np.full(n, alpha * (1 - l1_ratio)))
    return Fit(g.names, _from_centred(g, rest, b, mx, my), alpha, {"l1_ratio": l1_ratio})


def fit_lasso(g: Gram, alpha: float = 1.0) -> Fit:
    return fit_elastic_net(g, alpha, 1.0)


def lasso_path(g: Gram, n_alphas: int = 50, ratio: float = 1e-3) -> np.ndarray:
    _, _, xy, _, _ = _centred(g)
    top = np.abs(xy).max(initial=0.0)
    return np.logspace(np.log10(max(top, 1e-12)), np.log10(max(top, 1e-12) * ratio), n_alphas)


def fit_lasso_cv(total: Gram, folds: Sequence[Gram], n_alphas: int = 50) -> Fit:
    alphas = lasso_path(total, n_alphas)
    losses = [sum(squared_loss(f, fit_lasso(total - f, a).beta) / max(1, f.n) for f in folds) for a in alphas]
    return fit_lasso(total, float(alphas[int(np.argmin(losses))]))


def fit_adaptive_lasso(g: Gram, initial: np.ndarray | None = None, strength: float = 0.5, max_min_ratio: float = 1e6) -> Fit:
    """Lasso with weights 1 / |initial coefficient|, penalty 10^(log10(max / ratio) + log10(ratio) * strength); strength 0 is
    least squares, 1 leaves the intercept."""
    if strength == 0:
        return fit_ols(g)
    first = fit_ridge(g, 1.0).beta if initial is None else initial
    rest, xx, xy, mx, my = _centred(g)
    scale = np.abs(first[rest])
    w = np.where(scale > 0, scale, 1e-16)
    xx, xy = xx * np.outer(w, w), xy * w
    top = np.abs(xy).max(initial=0.0)
    if not top:
        return Fit(g.names, _from_centred(g, rest, np.zeros(len(rest)), mx, my))
    low = math.log10(top / max_min_ratio)
    lam = 10 ** (low + math.log10(max_min_ratio) * strength)
    n = len(rest)
    return Fit(g.names, _from_centred(g, rest, coordinate_descent(xx, xy, np.full(n, lam), np.zeros(n)) * w, mx, my), lam)


def fit_adaptive_lasso_cv(folds: Sequence[Gram], strengths: Sequence[float] | None = None, initial: np.ndarray | None = None, max_min_ratio: float = 1e6) -> Fit:
    """Adaptive lasso with the strength that has the least mean squared loss on held-out folds; of ties the strongest.

    Weights and penalties are those of all rows. Each fold's training sums are the total less the fold, and its path goes
    from the strongest penalty to the weakest, each fit starting from the one before.
    """
    strengths = sorted(np.linspace(0.05, 1.0, 39) if strengths is None else strengths, reverse=True)
    if not strengths or not all(0 < x <= 1 for x in strengths):
        raise ValueError("strengths lie above 0 and up to 1")
    total = total_of(folds)
    first = fit_ridge(total, 1.0).beta if initial is None else initial
    rest, _, xy, _, _ = _centred(total)
    w = np.maximum(np.abs(first[rest]), 1e-16)
    top = np.abs(xy * w).max(initial=0.0)
    if not top:
        return fit_adaptive_lasso(total, first, strengths[0], max_min_ratio)
    penalties = [top * max_min_ratio ** (x - 1) for x in strengths]
    losses = np.zeros(len(penalties))
    for f in folds:
        training = total - f
        if not f.n or not training.n:
            continue
        rest, xx, xy, mx, my = _centred(training)
        xx, xy, b = xx * np.outer(w, w), xy * w, np.zeros(len(rest))
        for k, lam in enumerate(penalties):
            b = coordinate_descent(xx, xy, np.full(len(rest), lam), np.zeros(len(rest)), start=b)
            losses[k] += squared_loss(f, _from_centred(training, rest, b * w, mx, my)) / f.n
    best = int(np.argmin(losses))
    out = fit_adaptive_lasso(total, first, strengths[best], max_min_ratio)
    return Fit(out.names, out.beta, out.alpha, {"strength": float(strengths[best]), "losses": dict(zip(map(float, strengths), losses.tolist(), strict=True))})


def fit_partial(g: Gram, l1: Sequence[str] = (), l1_alpha: float = 0.0, l2: Sequence[str] = (), l2_alpha: float = 0.0) -> Fit:
    """Some coefficients with an L1 penalty on the mean loss, some with L2 on the summed loss, as lasso and ridge have them; the others free."""
    rest, xx, xy, mx, my = _centred(g)
    names = [g.names[k] for k in rest]
    a = np.array([l1_alpha if n in l1 else 0.0 for n in names])
    b = np.array([l2_alpha / g.n if n in l2 else 0.0 for n in names])
    return Fit(g.names, _from_centred(g, rest, coordinate_descent(xx, xy, a, b), mx, my), l1_alpha, {"l2_alpha": l2_alpha})


def fit_quantile(df: DataFrame, columns: dict[str, Column], response: Column, q: float, rounds: int = 30, tol: float = 1e-2, delta: float = 1e-6) -> Fit:
    """Quantile regression by iterative reweighting; every round is one weighted sum over the rows."""
    g = gram(df, columns, response)
    beta = fit_ols(g).beta
    for _ in range(rounds):
        e = response - linear(columns, dict(zip(columns, beta, strict=True)))
        w = F.when(e > 0, q).otherwise(1 - q) / F.greatest(F.abs(e), F.lit(delta))
        new = fit_ols(gram(df, columns, response, w)).beta
        done = np.abs(new - beta).max(initial=0.0) < tol * max(1.0, np.abs(beta).max(initial=0.0)) * 1e-2
        beta = new
        if done:
            break
    return Fit(list(columns), beta, params={"q": q})


def fit_by_name(df: DataFrame, columns: dict[str, Column], response: Column, algorithm: str = "ridge", params: dict | None = None, weight: Column | None = None, folds: int = 5, order: Column | None = None):
    """Fit by algorithm name: ols, linear, statsmodels_ols, wls, ridge, lasso, elastic_net, adaptive_lasso, quantile_regression,
    and through pyspark.ml: gamma, rf, gradient_boosting. Penalties left out are chosen on contiguous folds."""
    params = dict(params or {})
    if algorithm == "quantile_regression":
        return fit_quantile(df, columns, response, params.get("quantile", 0.5))
    if algorithm in ("gamma", "statsmodels_glm", "rf", "gradient_boosting"):
        return fit_ml(df, columns, response, algorithm, params)
    if weight is not None and algorithm not in ("ridge", "wls", "statsmodels_wls"):
        raise ValueError(f"{algorithm} takes no weights")
    if algorithm in ("ols", "linear", "statsmodels_ols", "statsmodels_gls"):
        return fit_ols(gram(df, columns, response))
    if algorithm in ("wls", "statsmodels_wls"):
        return fit_ols(gram(df, columns, response, weight))
    if algorithm in ("ridge", "lasso") and params.get("alpha") is None:
        rows = gram_table(with_folds(df, folds, order), list(columns.values()), response, weight, ["_fold"]).collect()  # one matrix per fold
        parts = [gram_from(r.sums, list(columns)) for r in rows]
        total = Gram(parts[0].names, sum(p.xx for p in parts), sum(p.xy for p in parts), sum(p.yy for p in parts), sum(p.n for p in parts), sum(p.rows for p in parts))
        return fit_ridge_cv(total, parts, params.get("alphas")) if algorithm == "ridge" else fit_lasso_cv(total, parts)
    g = gram(df, columns, response, weight)
    if algorithm == "ridge":
        return fit_ridge(g, params["alpha"])
    if algorithm in ("lasso", "lasso_lars", "lars"):
        return fit_lasso(g, params.get("alpha", 1.0))
    if algorithm in ("elastic_net", "sgd"):
        return fit_elastic_net(g, params.get("alpha", 1.0), params.get("l1_ratio", 0.5))
    if algorithm == "adaptive_lasso":
        return fit_adaptive_lasso(g, strength=params.get("strength", 0.5))
    raise ValueError(f"unknown algorithm {algorithm}")


class MlFit:
    """A pyspark.ml model over the design columns."""

    def __init__(self, model, columns: dict[str, Column]):
        self.model, self.columns, self.names = model, columns, list(columns)

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        vector = df.withColumn("_x", array_to_vector(F.array(*[c.cast("double") for c in self.columns.values()])))
        return self.model.transform(vector).withColumnRenamed("prediction", out).drop("_x")

    def importances(self) -> dict[str, float]:
        return dict(zip(self.names, self.model.featureImportances.toArray().tolist(), strict=True))


def fit_ml(df: DataFrame, columns: dict[str, Column], response: Column, algorithm: str, params: dict | None = None) -> MlFit:
    from pyspark.ml import regression
    from pyspark.ml.functions import array_to_vector

    vector = df.select(array_to_vector(F.array(*[c.cast("double") for c in columns.values()])).alias("_x"), response.cast("double").alias("_y"))
    kind = {"gamma": "GeneralizedLinearRegression", "statsmodels_glm": "GeneralizedLinearRegression", "rf": "RandomForestRegressor", "gradient_boosting": "GBTRegressor"}[algorithm]
    extra = {"family": "gamma", "link": "log"} if kind.startswith("Gen") else {"seed": 1}
    return MlFit(getattr(regression, kind)(featuresCol="_x", labelCol="_y", **extra, **(params or {})).fit(vector), columns)


# ---- prediction and breakdown


def linear(columns: dict[str, Column], beta: dict[str, float]) -> Column:
    """Sum of coefficient times column, as one expression."""
    out = F.lit(0.0)
    for k, c in columns.items():
        if beta.get(k):
            out = out + F.lit(float(beta[k])) * c
    return out


def predict(df: DataFrame, columns: dict[str, Column], fit, out: str = "forecast", lower: float | None = None, upper: float | None = None) -> DataFrame:
    if isinstance(fit, MlFit):
        made = fit.predict(df, out)
    else:
        made = df.withColumn(out, linear(columns, fit.coefficients()))
    if lower is not None:
        made = made.withColumn(out, F.greatest(out, F.lit(lower)))
    return made.withColumn(out, F.least(out, F.lit(upper))) if upper is not None else made


def breakdown(df: DataFrame, columns: dict[str, Column], fit: Fit, groups: dict[str, str], remainder: str = "OTHER", centre: bool = False, denominator: str | None = None) -> DataFrame:
    """Adds one column per group of terms (first pattern that matches the term's start wins) and the rest; they add up to the prediction.

    With ``centre`` each part's mean is moved to the intercept's; with ``denominator`` parts are shares of that column.
    """
    from tidewater.schema import split_by_patterns

    beta = fit.coefficients()
    named, rest = split_by_patterns([k for k in columns if k != "Intercept"], groups)
    parts = {g: linear({k: columns[k] for k in ks}, beta) for g, ks in named.items()} | {remainder: linear({k: columns[k] for k in rest}, beta)}
    out = df.withColumns({"Intercept": F.lit(float(beta.get("Intercept", 0.0)))} | parts)
    if centre:
        means = out.agg(*[F.avg(g).alias(g) for g in parts]).first()
        out = out.withColumns({g: F.col(g) - F.lit(means[g]) for g in parts} | {"Intercept": F.col("Intercept") + F.lit(float(sum(means[g] or 0.0 for g in parts)))})
    if denominator:
        out = out.withColumns({g: F.col(g) / F.nullif(F.col(denominator), F.lit(0.0)) for g in ("Intercept", *parts)})
    return out


# ---- inference


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for k in range(1, 500):
        for num in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1 - beta_cdf(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2)


def effective_parameters(g: Gram, fit: Fit) -> float:
    """Rank for least squares; the trace of the smoother for ridge."""
    if not fit.alpha:
        return float(np.linalg.matrix_rank(g.xx))
    return float(np.trace(np.linalg.pinv(g.xx + _penalty(g.names, fit.alpha), hermitian=True) @ g.xx))


def summary(g: Gram, fit: Fit, coverage: float = 0.95) -> tuple[list[dict], dict]:
    """Coefficient rows (estimate, standard error, t, p, interval) and fit statistics, from the sums alone."""
    p = effective_parameters(g, fit)
    sse = max(0.0, squared_loss(g, fit.beta))
    i = g.names.index("Intercept") if "Intercept" in g.names else None
    sst = g.yy - (g.xy[i] ** 2 / g.n if i is not None else 0.0)
    dof = max(1e-9, g.rows - p)
    mse = sse / dof
    a = np.linalg.pinv(g.xx + _penalty(g.names, fit.alpha), hermitian=True)
    se = np.sqrt(np.maximum(0.0, np.diag(a @ g.xx @ a) * mse))
    low, high = 0.0, 1e4
    for _ in range(200):  # the t quantile by bisection
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, dof) > 1 - coverage else (low, mid)
    rows = []
    for k, name in enumerate(g.names):
        t = fit.beta[k] / se[k] if se[k] else float("nan")
        rows.append({"term": name, "estimate": float(fit.beta[k]), "std_err": float(se[k]), "t": float(t), "p": t_two_sided(t, dof) if se[k] else float("nan"), "lower": float(fit.beta[k] - high * se[k]), "upper": float(fit.beta[k] + high * se[k])})
    free = max(1e-9, p - (i is not None))
    f = (sst - sse) / free / mse if mse else float("inf")
    stats = {"n": g.rows, "p_effective": p, "sse": sse, "sst": sst, "r2": 1 - sse / sst if sst else float("nan"), "r2_adjusted": 1 - (sse / dof) / (sst / max(1, g.rows - 1)) if sst else float("nan"), "f": f, "f_p": f_upper(f, free, dof) if math.isfinite(f) else 0.0}
    loglik = -g.rows / 2 * (math.log(2 * math.pi * max(sse, 1e-300) / g.rows) + 1)
    stats |= {"aic": 2 * p - 2 * loglik, "bic": math.log(g.rows) * p - 2 * loglik}
    return rows, {k: v if k == "n" else float(v) for k, v in stats.items()}


def prediction_scale(columns: dict[str, Column], g: Gram, fit: Fit) -> Column:
    """sqrt(1 + x'Hx): how much wider a new row's interval is than the residuals', as a column."""
    a = np.linalg.pinv(g.xx + _penalty(g.names, fit.alpha), hermitian=True)
    h = a @ g.xx @ a
    # H = RR', so that x'Hx adds up (r'x)^2: one array of numbers, and no expression per pair of columns
    size, vectors = np.linalg.eigh((h + h.T) / 2)
    keep = size > max(size.max(initial=0.0), 0.0) * 1e-15
    roots = (vectors[:, keep] * np.sqrt(size[keep])).T
    if not len(roots):
        return F.lit(1.0)
    rows = F.expr("array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in r) + ")" for r in roots.tolist()) + ")")
    x = F.array(*[columns[k].cast("double") for k in g.names])

    def length(v: Column) -> Column:
        def add(so_far: Column, r: Column) -> Column:
            dot = F.aggregate(F.zip_with(r, v, lambda p, q: p * q), F.lit(0.0), lambda a, b: a + b)
            return so_far + dot * dot

        return F.aggregate(rows, F.lit(0.0), add)

    total = F.transform(F.array(x), length)[0]  # the columns are computed once a row
    return F.sqrt(1 + F.greatest(total, F.lit(0.0)))


def bootstrap_coefficients(df: DataFrame, columns: dict[str, Column], response: Column, fit: Callable[[Gram], Fit], samples: int = 100, seed: int = 1) -> DataFrame:
    """(sample, term, estimate): coefficients of Poisson resamples of the rows, all in one pass over the data."""
    p = len(columns) + 1
    names = list(columns)
    flat = df.select(F.array(*[c.cast("double") for c in columns.values()], response.cast("double")).alias("_v"), F.xxhash64(*[c.cast("double") for c in columns.values()], response.cast("double")).alias("_h"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((samples, (p) ** 2 + 2))
        for b in batches:
            m = np.array(b["_v"].tolist(), float).reshape(-1, p)
            # weights follow from the rows, so that a task that runs again draws the same
            rng = np.random.default_rng([seed, abs(int(b["_h"].sum())) % (1 << 62)])
            for k, w in enumerate(rng.poisson(1.0, (samples, len(m)))):
                total[k] += _gram_of(m, w.astype(float))
        yield pd.DataFrame({"sample": range(samples), "sums": list(total)})

    entries = flat.mapInPandas(part, "sample int, sums array<double>").select("sample", F.posexplode("sums").alias("i", "x")).groupBy("sample", "i").agg(F.sum("x").alias("x"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = pdf.sort_values("i")["x"].to_numpy()
        beta = fit(gram_from(sums, names)).beta
        return pd.DataFrame({"sample": int(pdf["sample"].iloc[0]), "term": names, "estimate": beta})

    return entries.groupBy("sample").applyInPandas(solve, "sample int, term string, estimate double")


# ---- penalised quantiles, choices on folds, inference by splits


def fit_l1_quantile(df: DataFrame, columns: dict[str, Column], response: Column, q: float, alpha: float, rounds: int = 30, delta: float = 1e-6) -> Fit:
    """Quantile regression with an L1 penalty on all but the intercept: reweighted sums, each followed by coordinate descent."""
    beta = fit_ols(gram(df, columns, response)).beta
    for _ in range(rounds):
        e = response - linear(columns, dict(zip(columns, beta, strict=True)))
        w = F.when(e > 0, q).otherwise(1 - q) / F.greatest(F.abs(e), F.lit(delta))
        g = gram(df, columns, response, w)
        p = np.array([0.0 if n == "Intercept" else alpha / g.n * g.rows for n in g.names])
        new = coordinate_descent(g.xx / g.n, g.xy / g.n, p, np.zeros(len(p)))
        done = np.abs(new - beta).max(initial=0.0) < 1e-4 * max(1.0, np.abs(beta).max(initial=0.0))
        beta = new
        if done:
            break
    return Fit(list(columns), beta, alpha, {"q": q})


def with_folds(df: DataFrame, folds: int, order: Column | None = None) -> DataFrame:
    """Adds _fold, 1 to ``folds``: runs of rows in order, cut at quantiles of the order, so that nothing is sorted.

    Rows equal in order share a fold; without an order, or where it has one value only, rows run as they are read.
    """
    as_read = F.monotonically_increasing_id()
    at = [k / folds for k in range(1, folds)]
    for chosen in ([] if order is None else [order]) + [as_read]:
        placed = df.withColumn("_order", chosen)
        row = placed.agg(F.percentile_approx("_order", at, 10_000).alias("q"), F.max("_order").alias("most")).first()
        bounds = [b for b in row.q or [] if b < row.most]
        if bounds:
            break
    above = reduce(lambda a, b: a + b, [F.when(F.col("_order") > F.lit(b), 1).otherwise(0) for b in bounds], F.lit(1))
    return placed.withColumn("_fold", above).drop("_order")


def contiguous_folds(df: DataFrame, columns: dict[str, Column], response: Column, folds: int, order: Column) -> list[Gram]:
    """Sums of each of ``folds`` runs of rows in the given order."""
    rows = gram_table(with_folds(df, folds, order), list(columns.values()), response, None, ["_fold"]).collect()  # one matrix per fold
    return [gram_from(r.sums, list(columns)) for r in rows]


def total_of(parts: Sequence[Gram]) -> Gram:
    return Gram(parts[0].names, sum(p.xx for p in parts), sum(p.xy for p in parts), sum(p.yy for p in parts), sum(p.n for p in parts), sum(p.rows for p in parts))


def fit_partial_cv(folds: Sequence[Gram], l1: Sequence[str], l1_alphas: Sequence[float], l2: Sequence[str], l2_alphas: Sequence[float]) -> Fit:
    """The pair of penalties with the smallest loss on held-out folds."""
    total = total_of(folds)
    best = min(itertools.product(l1_alphas, l2_alphas), key=lambda a: sum(squared_loss(f, fit_partial(total - f, l1, a[0], l2, a[1]).beta) for f in folds))
    return fit_partial(total, l1, best[0], l2, best[1])


def split_inference(df: DataFrame, columns: dict[str, Column], response: Column, alpha: float, splits: int = 50, seed: int = 1, least_gamma: float = 0.05) -> dict[str, float]:
    """P-values of lasso coefficients: on half of the rows lasso selects, on the other half least squares tests what was selected,
    times the number selected; over all splits the smallest scaled quantile. All splits are summed up in one pass."""
    p = len(columns) + 1
    names = list(columns)
    flat = df.select(F.array(*[c.cast("double") for c in columns.values()], response.cast("double")).alias("_v"), F.xxhash64(*[c.cast("double") for c in columns.values()], response.cast("double")).alias("_h"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2 * splits, p * p + 2))
        for b in batches:
            m = np.array(b["_v"].tolist(), float).reshape(-1, p)
            h = b["_h"].to_numpy(np.int64).view(np.uint64)
            for k in range(splits):
                bits = (h * np.uint64(2 * (seed * 1000 + k) + 1)) >> np.uint64(63)
                for side in (0, 1):
                    total[2 * k + side] += _gram_of(m[bits == side], np.ones(int((bits == side).sum())))
        yield pd.DataFrame({"k": range(2 * splits), "sums": list(total)})

    entries = flat.mapInPandas(part, "k int, sums array<double>").select("k", F.posexplode("sums").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x"))
    rows = entries.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("e")).collect()  # one matrix per half
    grams = {r.k: gram_from([e.x for e in r.e], names) for r in rows}
    found = {n: [] for n in names}
    for k in range(splits):
        chosen = [n for n, b in fit_lasso(grams[2 * k], alpha).coefficients().items() if b or n == "Intercept"]
        at = [names.index(n) for n in chosen]
        g = grams[2 * k + 1]
        half = Gram(chosen, g.xx[np.ix_(at, at)], g.xy[at], g.yy, g.n, g.rows)
        tested = {r["term"]: r["p"] for r in summary(half, fit_ols(half))[0]}
        for n in names:
            v = tested.get(n, 1.0)
            found[n].append(min(1.0, (v if v == v else 1.0) * max(1, len(chosen) - 1)) if n in tested else 1.0)
    out = {}
    for n, ps in found.items():
        gammas = np.arange(least_gamma, 1.0, 0.05)
        q = [min(1.0, float(np.quantile(np.array(ps) / g, g))) for g in gammas]
        out[n] = min(1.0, (1 - math.log(least_gamma)) * min(q))
    return out
