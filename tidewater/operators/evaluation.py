"""Rolling-origin evaluation, grouping and the choice of configurations."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.schema import TIME, VALUE

#: Fixed value: seed of the choice among splits.
SPLIT_SEED = 48912


def rolling_splits(n: int, horizon: int, min_train: int | None = None, step: int | None = None, gap: int = 0, expanding: bool = False, max_splits: int | None = None, most_recent: bool = False, seed: int = SPLIT_SEED) -> list[tuple[range, range]]:
    """(train rows, test rows) by number, the oldest first; the last test ends at row n - 1.

    Over ``max_splits`` the last, the one before and a seeded choice of the others stay (or the most recent); without
    any split one of 90 % training rows remains.
    """
    min_train = 2 * horizon if min_train is None else min_train
    step = horizon if step is None else step
    ends, end = [], n - 1
    while end - horizon + 1 - gap - min_train >= 0:
        ends.append(end)
        end -= step
    ends.reverse()
    if not ends:
        cut = round(0.9 * n)
        return [(range(0, cut), range(cut, n))]
    if max_splits is not None and len(ends) > max_splits:
        if most_recent:
            ends = ends[-max_splits:] if max_splits else []
        else:
            last = ends[-2:] if max_splits > 1 else ends[-1:]
            others = ends[: -len(last)]
            ends = sorted([*random.Random(seed).sample(others, max_splits - len(last)), *last])
    out = []
    for e in ends:
        test = range(e - horizon + 1, e + 1)
        stop = test.start - gap
        out.append((range(0 if expanding else stop - min_train, stop), test))
    return out


def split_table(sizes: DataFrame, horizon: int, min_train: int, step: int, gap: int = 0, expanding: bool = True) -> DataFrame:
    """All rolling splits of every series of ``sizes`` (keys, n): row numbers, back = how many steps before the last."""
    most = F.floor((F.col("n") - horizon - gap - min_train) / step)
    k = sizes.filter(most >= 0).withColumn("back", F.explode(F.sequence(F.lit(0).cast("long"), most)))
    start = F.col("n") - horizon - F.col("back") * step
    stop = start - gap - 1
    return k.withColumns({"test_start": start, "test_end": start + horizon - 1, "train_start": F.lit(0).cast("long") if expanding else stop - min_train + 1, "train_end": stop}).drop("n")


def with_rolling_roles(df: DataFrame, horizon: int, step: int, splits: int, keys: Sequence[str] = (), gap: int = 0, min_train: int | None = None, ts: str = TIME) -> DataFrame:
    """Every row once for each split that it has a part in: back (from 0, the last) and role train or test.

    The rows are repeated ``splits`` times at most; all splits then run as one job, keyed by (keys, back).
    """
    w = Window.partitionBy(*keys)
    numbered = df.withColumns({"_i": F.row_number().over(w.orderBy(ts)) - 1, "_n": F.count("*").over(w)})
    each = numbered.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    start = F.col("_n") - horizon - F.col("back") * step
    stop = start - gap
    train = F.col("_i") < stop
    if min_train is not None:
        train = train & (F.col("_i") >= stop - min_train)
    role = F.when(train, "train").when((F.col("_i") >= start) & (F.col("_i") < start + horizon), "test")
    return each.withColumn("role", role).filter("role is not null").drop("_i", "_n")


def grouped_runs(df: DataFrame, run: Callable[[pd.DataFrame, dict], pd.DataFrame], configs: DataFrame, schema: str, by: Sequence[str]) -> DataFrame:
    """``run(rows, config)`` for every group and configuration, in parallel; configurations are few and broadcast."""
    names = configs.columns
    each = df.crossJoin(F.broadcast(configs))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        config = pdf[names].iloc[0].to_dict()
        out = run(pdf.drop(columns=[c for c in names if c not in by]), config)
        return out.assign(**config)

    return each.groupBy(*by, *[c for c in names if c not in by]).applyInPandas(one, schema)


def rank_configs(scores: DataFrame, metric: str, keys: Sequence[str], config: Sequence[str], greater_is_better: bool = False) -> DataFrame:
    """Adds rank (equal scores share the smallest) and best (the first by configuration of the top rank)."""
    w = Window.partitionBy(*keys)
    order = F.col(metric).desc() if greater_is_better else F.col(metric).asc()
    ranked = scores.withColumns({"rank": F.rank().over(w.orderBy(order)), "_first": F.row_number().over(w.orderBy(order, *config))})
    return ranked.withColumn("best", F.col("_first") == 1).drop("_first")


def summarise_search(cv: DataFrame, metrics: Sequence[str], config: Sequence[str]) -> DataFrame:
    """Mean, deviation and split values of test (and train) metrics per configuration."""
    aggs = []
    for c in metrics:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"), F.sort_array(F.collect_list(F.struct("split", c)))[c].alias(f"splits_{c}")]
    return cv.groupBy(*config).agg(*aggs)


def group_quantiles(df: DataFrame, by: Sequence[str], quantiles: Sequence[float], value: str = VALUE, centre: bool = False) -> DataFrame:
    """Mean and quantiles per group; with ``centre`` less the mean of the group means."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.array(*[F.lit(q) for q in quantiles])).alias("_q"))
    cols = {"mean": F.col("mean")} | {f"q{q * 100:g}".replace(".", "_"): F.col("_q")[k] for k, q in enumerate(quantiles)}
    if centre:
        middle = F.avg("mean").over(Window.partitionBy())
        cols = {k: c - middle for k, c in cols.items()}
    return out.select(*by, *[c.alias(k) for k, c in cols.items()])


def overlay(df: DataFrame, by: str, over: str, values: Sequence, value: str = VALUE) -> DataFrame:
    """Mean per group, one column for each given value of ``over``."""
    return df.groupBy(by).pivot(over, list(values)).agg(F.avg(value))


def with_blocks(df: DataFrame, size: int, keys: Sequence[str] = (), ts: str = TIME, complete: str = "last") -> DataFrame:
    """Adds block: the number of the run of ``size`` rows, the last one complete (or the first)."""
    from tidewater.operators.timegrid import block_index

    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(ts)), "_n": F.count("*").over(w)})
    return ranked.withColumn("block", block_index("_n", F.col("_i"), size, complete)).drop("_i", "_n")


def flexible_grouping(df: DataFrame, rows: dict[str, Column], by: Sequence[str], aggs: dict[str, Column], unpack: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Row columns, then aggregates by group, then array results as columns of the given names."""
    out = df.withColumns(rows).groupBy(*by).agg(*[c.alias(k) for k, c in aggs.items()])
    for k, names in (unpack or {}).items():
        out = out.withColumns({n: F.col(k)[i] for i, n in enumerate(names)}).drop(k)
    return out
