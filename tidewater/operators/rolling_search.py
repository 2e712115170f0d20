"""Choice of configurations by rolling origins, for many series, in a number of jobs that depends on neither splits, configurations nor series.

All specifications share one design table: the union of their columns. Cut points of the splits divide each series into
blocks of rows, counted from its end; one pass adds up a matrix per series and block. The training rows of a split are a
run of blocks, a specification is a choice of columns: every fit is solved on a sum of matrices and its rows and columns.
Only test rows meet fits, once for each split that tests them and each specification.

Calendar origins are those of the whole series, and missing values are filled over it before they are lagged. Penalties
that a specification leaves open are chosen on the blocks of the split as folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import metrics
from tidewater.functions.calendar import add_time_features, continuous_year
from tidewater.operators import lags, series_models
from tidewater.operators.linear_model import ModelSpec
from tidewater.operators.regression import Gram
from tidewater.operators.series_models import Sums, term_sum
from tidewater.schema import ACTUAL, FORECAST, TIME, VALUE
from tidewater.staging import staged, unstage


@dataclass(frozen=True)
class Split:
    """Rows by how many come after them: test rows from ``test`` on, ``horizon`` of them back; training rows from ``train`` back to ``end`` (None: all)."""

    test: int
    horizon: int
    train: int
    end: int | None = None


def splits_from_end(splits: Sequence[tuple[range, range]], n: int, expanding: bool = True) -> list[Split]:
    """Splits of rows 0 to n - 1, as ``evaluation.rolling_splits`` gives them, counted from the end."""
    return [Split(n - test.stop, len(test), n - train.stop, None if expanding else n - train.start) for train, test in splits]


def _union(terms: Sequence[dict]) -> dict:
    """All lags of several specifications, each once."""
    out: dict[str, list] = {}
    for kind in ("orders", "sets", "intervals"):
        every = [tuple(x) if isinstance(x, (list, tuple)) else x for t in terms for x in t.get(kind, ())]
        if every:
            out[kind] = list(dict.fromkeys(every))
    return out


def shared_design(df: DataFrame, specs: Sequence[ModelSpec], keys: Sequence[str], events: DataFrame | None, ts: str, value: str) -> tuple[DataFrame, list[str], list[list[str]]]:
    """(keys, ts, y, _back, x) with the columns of all specifications, their names, and the names of each specification."""
    first = df.groupBy(*keys).agg(continuous_year(F.min(ts)).alias(series_models._ORIGIN))
    wanted = list(dict.fromkeys(c for s in specs for c in series_models.calendar_of(s)))
    every = replace(specs[0], event_keys=list(dict.fromkeys(k for s in specs for k in s.event_keys)))
    placed = series_models._events_of(series_models._meet(df, first, keys), events, every, ts)
    timed = add_time_features(placed, wanted, ts, F.col(series_models._ORIGIN)) if wanted else placed
    lagged = {value: _union([s.autoreg for s in specs if s.autoreg])}
    for col in dict.fromkeys(c for s in specs for c in s.lagged_regressors):
        lagged[col] = _union([s.lagged_regressors[col] for s in specs if col in s.lagged_regressors])
    for col, terms in lagged.items():
        timed = lags.add_lags(timed, col, keys=keys, ts=ts, **terms) if terms else timed
    columns: dict[str, Column] = {}
    known: dict[str, tuple] = {}
    names: list[list[str]] = []
    for k, s in enumerate(specs):
        own = []
        for name, c in series_models._columns(timed, s, value).items():
            # changepoints are numbered: those of other dates get the number of their specification
            mark = tuple(s.changepoints) if name.startswith("changepoint") else ()
            name = name if known.get(name, mark) == mark else f"{name}@{k}"
            known[name] = mark
            columns.setdefault(name, c)
            own.append(name)
        names.append(own)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc())) - 1
    return timed.select(*keys, ts, F.col(value).cast("double").alias(value), back.alias("_back"), F.array(*[c.cast("double") for c in columns.values()]).alias("x")), list(columns), names


def _sub(g: Gram, at: Sequence[int]) -> Gram:
    return Gram([g.names[i] for i in at], g.xx[np.ix_(at, at)], g.xy[at], g.yy, g.n, g.rows)


def fit_splits(design: DataFrame, specs: Sequence[ModelSpec], splits: Sequence[Split], names: Sequence[str], own: Sequence[Sequence[str]], keys: Sequence[str], value: str = VALUE) -> DataFrame:
    """(keys, config, split, terms): all fits of all series. Series too short for a split have none for it."""
    keys, cuts = list(keys), sorted({b for s in splits for b in (s.train, s.end) if b is not None})
    block = reduce(lambda a, b: a + b, [(F.col("_back") >= b).cast("int") for b in cuts], F.lit(0))
    unsure = sorted({names.index(o[i]) for s, o in zip(specs, own, strict=True) for i in series_models.nullable([n.split("@")[0] for n in o], s)})
    parts = series_models.sums_table(design.withColumn("_block", block), [*keys, "_block"], len(names), unsure, None, value)
    at = [[names.index(n) for n in o] for o in own]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for j, s in enumerate(splits):
            low_block, high_block = cuts.index(s.train) + 1, len(cuts) if s.end is None else cuts.index(s.end)
            mine = rows[(rows["_block"] >= low_block) & (rows["_block"] <= high_block)]
            if mine.empty:
                continue
            total = Sums.of(mine, names, unsure)
            if not total.n:
                continue
            low, width = total.ranges()
            g = total.scaled(low, width)
            folds = [Sums.of(f, names, unsure).scaled(low, width) for _, f in mine.groupby("_block")]
            for k, spec in enumerate(specs):
                used = spec
                if len(folds) < 2 and spec.algorithm in ("ridge", "lasso", "lasso_lars", "lars") and spec.params.get("alpha") is None:
                    used = replace(spec, params={**spec.params, "alpha": 1.0})
                beta = series_models.fit_gram(_sub(g, at[k]), used, [_sub(f, at[k]) for f in folds if f.rows]).beta
                slope = np.zeros(len(names))
                slope[at[k]] = beta / width[at[k]]
                terms = [{"low": a, "width": b, "slope": c} for a, b, c in zip(low.tolist(), width.tolist(), slope.tolist(), strict=True)]
                out.append({**{c: rows[c].iloc[0] for c in keys}, "config": k, "split": j, "terms": terms})
        if not out:
            out.append({**{c: rows[c].iloc[0] for c in keys}, "config": -1, "split": -1, "terms": []})
        return pd.DataFrame(out)

    kinds = {f.name: f.dataType.simpleString() for f in design.schema}
    shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "config int, split int, terms array<struct<low: double, width: double, slope: double>>"])
    grouped = parts.groupBy(*keys) if keys else parts.groupBy(F.lit(0).alias("_one"))
    return grouped.applyInPandas(solve, shape).filter("config >= 0")


def _limited(c: Column, specs: Sequence[ModelSpec]) -> Column:
    for k, s in enumerate(specs):
        if s.lower is not None or s.upper is not None:
            c = F.when(F.col("config") == k, series_models._clipped(c, s)).otherwise(c)
    return c


def predict_splits(design: DataFrame, fits: DataFrame, specs: Sequence[ModelSpec], splits: Sequence[Split], names: Sequence[str], own: Sequence[Sequence[str]], keys: Sequence[str], ts: str = TIME, value: str = VALUE) -> DataFrame:
    """(keys, config, split, ts, actual, forecast) of all test rows; lags that reach past training see forecasts."""
    keys = list(keys)

    def exploded(ranges: Sequence[tuple[int, int]], which: Sequence[int]) -> DataFrame:
        mine = F.array(*[F.when((F.col("_back") >= a) & (F.col("_back") < b), F.lit(j)) for j, (a, b) in zip(which, ranges, strict=True)])
        return design.withColumn("split", F.explode(F.filter(mine, lambda j: j.isNotNull())))

    spans = [lags.lag_span(*[(s.autoreg or {}).get(k, ()) for k in ("orders", "sets", "intervals")]) for s in specs]
    ahead = [s.train - s.test for s in splits]  # rows from the end of training to the end of the test
    chained = [k for k, s in enumerate(specs) if s.autoreg and spans[k][0] < max(ahead)]
    straight = exploded([(s.test, s.test + s.horizon) for s in splits], range(len(splits)))
    made = straight.join(fits.filter(~F.col("config").isin(chained)) if chained else fits, [*keys, "split"])
    out = made.select(*keys, "config", "split", ts, F.col(value).alias(ACTUAL), _limited(term_sum(), specs).alias(FORECAST))
    if not chained:
        return out
    longest = max(spans[k][1] for k in chained)
    rows = exploded([(s.test, s.train + longest) for s in splits], range(len(splits)))
    lagged = {k: [(names.index(n), ks) for n, ks in series_models.lag_names(specs[k], value) if n in own[k]] for k in chained}
    every = sorted({i for found in lagged.values() for i, _ in found})
    still = F.array(*[F.lit(None).cast("double") if i in every else F.col("x")[i] for i in range(len(names))])
    based = rows.withColumn("x", still).join(fits.filter(F.col("config").isin(chained)), [*keys, "split"])
    based = based.select(*keys, "config", "split", ts, value, "_back", term_sum().alias("_base"), F.array(*[F.col("terms")[i] for i in every]).alias("_slopes"))
    limits = [(s.lower, s.upper) for s in specs]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_back", ascending=False)
        k, split = int(pdf["config"].iloc[0]), splits[int(pdf["split"].iloc[0])]
        # missing values of history are filled from history alone
        known = pdf.loc[pdf["_back"] >= split.train, value].bfill().ffill().tolist()
        later = pdf[pdf["_back"] < split.train]
        slopes = pdf["_slopes"].iloc[0]
        lower, upper = limits[k]
        made = []
        for base in later["_base"]:
            y = base
            for i, ks in lagged[k]:
                some = [known[-lag] for lag in ks if lag <= len(known)]
                if some:
                    s = slopes[every.index(i)]
                    y += s["slope"] * (float(np.mean(some)) - s["low"])
            y = y if lower is None else max(lower, y)
            y = y if upper is None else min(upper, y)
            known.append(y)
            made.append(y)
        later = later.assign(**{FORECAST: made, ACTUAL: later[value]})
        return later[later["_back"] < split.test + split.horizon][[*keys, "config", "split", ts, ACTUAL, FORECAST]]

    kinds = {f.name: f for f in based.schema}
    shape = T.StructType([kinds[c] for c in (*keys, "config", "split", ts)] + [T.StructField(c, T.DoubleType()) for c in (ACTUAL, FORECAST)])
    return out.unionByName(based.groupBy(*keys, "config", "split").applyInPandas(run, shape))


def rolling_scores(df: DataFrame, specs: Sequence[ModelSpec], splits: Sequence[Split], keys: Sequence[str] = (), events: DataFrame | None = None, names: Sequence[str] = ("MAE", "RMSE"), ts: str = TIME, value: str = VALUE) -> DataFrame:
    """(keys, config, split, metrics): errors of every specification on every split of every series; splits are numbered as given."""
    made, columns, own = shared_design(df, specs, keys, events, ts, value)
    design = staged(made, "search")
    fits = staged(fit_splits(design, specs, splits, columns, own, keys, value), "fits")
    rows = predict_splits(design, fits, specs, splits, columns, own, keys, ts, value)
    out = staged(metrics.evaluate(rows.filter(F.col(ACTUAL).isNotNull()), [*keys, "config", "split"], names), "scores")
    unstage(design, fits)
    return out


def best_configs(scores: DataFrame, metric: str, keys: Sequence[str] = (), more_is_better: bool = False) -> DataFrame:
    """(keys, config, mean): of each series the configuration with the best mean over its splits, of equal ones the first."""
    means = scores.groupBy(*keys, "config").agg(F.avg(metric).alias("mean")).filter(F.col("mean").isNotNull())
    order = F.col("mean").desc() if more_is_better else F.col("mean")
    return means.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "config"))).filter("_k = 1").drop("_k")
