"""Anomaly detection: rewards, parameter search, error- and interval-based detectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import clean, labels
from tidewater.operators.intervals import slice_distributions
from tidewater.schema import ACTUAL, ANOMALY, FORECAST, PREDICTED_ANOMALY, TIME

#: Coverages tried by default.
COVERAGES = [round(0.05 * k, 2) for k in range(1, 20)] + [0.96, 0.97, 0.98, 0.99, 0.995, 0.999]


@dataclass(frozen=True)
class Reward:
    """An aggregate over scored rows (truth and prediction columns), with a penalty outside of bounds; rewards add and multiply."""

    value: Callable[[Column, Column], Column]
    lowest: float | None = None
    highest: float | None = None
    how: str = "additive"
    penalty: float = -1.0

    def column(self, true: Column, pred: Column) -> Column:
        v = self.value(true, pred)
        if self.lowest is None and self.highest is None:
            return v
        bad = F.lit(False)
        if self.lowest is not None:
            bad = bad | (v < self.lowest)
        if self.highest is not None:
            bad = bad | (v > self.highest)
        fined = {"additive": lambda: v + self.penalty, "multiplicative": lambda: v * self.penalty, "PENALTY_ONLY": lambda: F.lit(float(self.penalty))}[self.how]()
        fine = F.lit(0.0) if self.how == "PENALTY_ONLY" else v
        return F.when(bad, fined).otherwise(fine)

    def __add__(self, other: Reward | float) -> Reward:
        return Reward(lambda t, p: self.column(t, p) + (other.column(t, p) if isinstance(other, Reward) else float(other)))

    def __mul__(self, other: Reward | float) -> Reward:
        return Reward(lambda t, p: self.column(t, p) * (other.column(t, p) if isinstance(other, Reward) else float(other)))

    def __truediv__(self, other: Reward | float) -> Reward:
        return Reward(lambda t, p: self.column(t, p) / (F.nullif(other.column(t, p), F.lit(0.0)) if isinstance(other, Reward) else float(other)))

    __radd__, __rmul__ = __add__, __mul__


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


PRECISION = Reward(lambda t, p: _rate(F.count_if(t & p), F.count_if(p)))
RECALL = Reward(lambda t, p: _rate(F.count_if(t & p), F.count_if(t)))
F1 = Reward(lambda t, p: _rate(2 * F.count_if(t & p), F.count_if(t) + F.count_if(p)))
OBJECTIVES = {"PRECISION": PRECISION, "RECALL": RECALL, "F1": F1}


def percent_reward(target_low: float, target_high: float) -> Reward:
    """How near the share of predicted anomalies (in percent) is to the middle of a range: minus the distance over 100."""
    middle = (target_low + target_high) / 2
    return Reward(lambda t, p: -F.abs(100 * F.avg(p.cast("double")) - middle) / 100)


def config_reward(objective: str | None = "F1", target_percent: float | None = None, band: float = 0.1, min_precision: float | None = None, min_recall: float | None = None) -> Reward:
    """An objective, a target share of anomalies within a band, and floors under precision and recall with a penalty of -1."""
    parts = [OBJECTIVES[objective]] if objective else []
    if target_percent is not None:
        share = Reward(lambda t, p: 100 * F.avg(p.cast("double")), target_percent * (1 - band), target_percent * (1 + band), "PENALTY_ONLY", -1.0)
        parts.append(share)
    if min_precision is not None:
        parts.append(Reward(PRECISION.value, min_precision, None, "PENALTY_ONLY", -1.0))
    if min_recall is not None:
        parts.append(Reward(RECALL.value, min_recall, None, "PENALTY_ONLY", -1.0))
    return reduce(lambda a, b: a + b, parts)


def param_grid(spark: SparkSession, params: dict[str, Sequence]) -> DataFrame:
    """All combinations with their place in the order, param_id; earlier names vary slowest. The grid is small by nature."""
    import itertools

    rows = [(k, *c) for k, c in enumerate(itertools.product(*params.values()))]
    return spark.createDataFrame(rows, ["param_id", *params])


def score_grid(rows: DataFrame, grid: DataFrame, predicted: Column, reward: Reward, true: str = ANOMALY, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, parameters, reward) of every combination: rows meet the broadcast grid and are added up, all in one job."""
    each = rows.crossJoin(F.broadcast(grid)).withColumn(PREDICTED_ANOMALY, F.coalesce(predicted, F.lit(False)))
    truth = F.col(true) if true in rows.columns else F.lit(False)
    return each.groupBy(*keys, *grid.columns).agg(reward.column(truth, F.col(PREDICTED_ANOMALY)).alias("reward"))


def best_params(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The combination with the largest reward; of equal ones the first."""
    rest = [c for c in scores.columns if c not in keys]
    return scores.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("reward", -F.col("param_id"))).alias("b")).select(*keys, "b.*")


def optimise_constrained(df: DataFrame, objective: str, constraint: str, least: float) -> DataFrame:
    """The row with the best objective among those that meet the constraint, else the row with the best constraint."""
    ok = F.col(constraint) >= least
    return df.withColumn("_ok", ok).orderBy(F.desc("_ok"), F.when(ok, F.col(objective)).otherwise(F.col(constraint)).desc(), F.when(ok, F.col(constraint)).otherwise(F.col(objective)).desc()).limit(1).drop("_ok")


def join_forecasts(actuals: DataFrame, forecasts: dict[str, DataFrame], on: Sequence[str], value: str = FORECAST) -> DataFrame:
    """Rows that all frames share, with one column per forecast: {name}_{value}."""
    return reduce(lambda a, kv: a.join(kv[1].select(*on, F.col(value).alias(f"{kv[0]}_{value}")), list(on)), forecasts.items(), actuals)


def ape(actual: Sequence[Column], forecast: Sequence[Column]) -> Column:
    """Relative error of a vector, in percent: length of the difference over length of the actual."""
    gap = reduce(lambda a, b: a + b, [F.pow(y - p, F.lit(2)) for y, p in zip(actual, forecast, strict=True)])
    size = reduce(lambda a, b: a + b, [F.pow(y, F.lit(2)) for y in actual])
    return 100 * F.sqrt(gap) / F.nullif(F.sqrt(size), F.lit(0.0))


@dataclass
class ApeDetector:
    """Rows whose relative error is above a threshold, which is fitted to a reward."""

    reward: Reward
    thresholds: Sequence[float]
    actual: Sequence[str] = (ACTUAL,)
    forecast: Sequence[str] = (FORECAST,)
    threshold: float | None = None

    def scored(self, df: DataFrame) -> DataFrame:
        return df.withColumn("ape", ape([F.col(c) for c in self.actual], [F.col(c) for c in self.forecast]))

    def fit(self, df: DataFrame, true: str = ANOMALY) -> ApeDetector:
        grid = param_grid(df.sparkSession, {"threshold": [float(t) for t in self.thresholds]})
        self.threshold = best_params(score_grid(self.scored(df), grid, F.col("ape") > F.col("threshold"), self.reward, true)).first().threshold
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.scored(df).withColumn(PREDICTED_ANOMALY, F.coalesce(F.col("ape") > F.lit(self.threshold), F.lit(False)))


@dataclass
class BestForecastDetector:
    """An error detector over several forecasts: the forecast and threshold with the best reward."""

    reward: Reward
    thresholds: Sequence[float]
    names: Sequence[str] = ()
    choice: tuple[str, float] | None = None

    def fit(self, df: DataFrame, true: str = ANOMALY) -> BestForecastDetector:
        long = df.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"{n}_{FORECAST}").alias("_p")) for n in self.names])).alias("_m")).select("*", "_m.*")
        grid = param_grid(df.sparkSession, {"threshold": [float(t) for t in self.thresholds]})
        scores = score_grid(long.withColumn("ape", ape([F.col(ACTUAL)], [F.col("_p")])), grid, F.col("ape") > F.col("threshold"), self.reward, true, ["model"])
        best = scores.orderBy(F.desc("reward"), "param_id", "model").first()
        self.choice = (best.model, best.threshold)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        name, threshold = self.choice
        return df.withColumn("ape", ape([F.col(ACTUAL)], [F.col(f"{name}_{FORECAST}")])).withColumn(PREDICTED_ANOMALY, F.coalesce(F.col("ape") > F.lit(threshold), F.lit(False)))


@dataclass
class IntervalDetector:
    """Rows outside a residual interval by slice, and optionally with large relative errors; coverage and slices fitted to a reward.

    All slice deviations come from one aggregation per set of slicing columns; the grid of coverages is then a join.
    """

    reward: Reward
    coverages: Sequence[float] = field(default_factory=lambda: list(COVERAGES))
    volatility: Sequence[Sequence[str]] = ((),)
    ape_thresholds: Sequence[float] = (0.0,)
    sape_thresholds: Sequence[float] = (0.0,)
    min_rows: int = 5
    params: dict | None = None
    slices: DataFrame | None = None

    def _with_std(self, df: DataFrame, by: Sequence[str], slices: DataFrame) -> DataFrame:
        if not by:
            return df.crossJoin(F.broadcast(slices.select(F.col("std").alias("_std"))))
        overall = slices.agg(F.sqrt(F.sum(F.col("std") * F.col("std") * F.col("n")) / F.sum("n")).alias("_all"))
        known = slices.filter(F.col("n") >= self.min_rows).select(*by, F.col("std").alias("_s"))
        return df.join(known, list(by), "left").crossJoin(F.broadcast(overall)).withColumn("_std", F.coalesce("_s", "_all")).drop("_s", "_all")

    @staticmethod
    def _rows(df: DataFrame) -> DataFrame:
        y, p = F.col(ACTUAL), F.col(FORECAST)
        return df.withColumns({"_r": y - p, "_ape": 100 * F.abs(y - p) / F.nullif(F.abs(y), F.lit(0.0)), "_sape": 100 * F.abs(y - p) / F.nullif(F.abs(y) + F.abs(p), F.lit(0.0))})

    @staticmethod
    def _outside() -> Column:
        beyond = F.abs("_r") > F.col("z") * F.col("_std")
        return beyond & (F.coalesce(F.col("_ape"), F.lit(float("inf"))) > F.col("ape_threshold")) & (F.coalesce(F.col("_sape"), F.lit(0.0)) > F.col("sape_threshold"))

    def fit(self, df: DataFrame, true: str = ANOMALY) -> IntervalDetector:
        spark = df.sparkSession
        z = [(float(c), NormalDist().inv_cdf(0.5 + c / 2)) for c in self.coverages]
        grid = param_grid(spark, {"coverage": [c for c, _ in z], "ape_threshold": [float(x) for x in self.ape_thresholds], "sape_threshold": [float(x) for x in self.sape_thresholds]})
        grid = grid.join(F.broadcast(spark.createDataFrame(z, "coverage double, z double")), "coverage").select("param_id", "coverage", "z", "ape_threshold", "sape_threshold")
        rows, best = self._rows(df), None
        for by in self.volatility:
            slices = slice_distributions(rows, "_r", [0.5], by)
            top = best_params(score_grid(self._with_std(rows, by, slices), grid, self._outside(), self.reward, true)).first()
            if best is None or top.reward > best[0].reward:
                best = (top, list(by), slices)
        top, by, self.slices = best
        self.params = {"coverage": top.coverage, "z": top.z, "ape_threshold": top.ape_threshold, "sape_threshold": top.sape_threshold, "by": by}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        p = self.params
        rows = self._with_std(self._rows(df), p["by"], self.slices).withColumns({k: F.lit(p[k]) for k in ("z", "ape_threshold", "sape_threshold")})
        width = F.col("z") * F.col("_std")
        out = rows.withColumns({PREDICTED_ANOMALY: F.coalesce(self._outside(), F.lit(False)), "forecast_lower": F.col(FORECAST) - width, "forecast_upper": F.col(FORECAST) + width, "z_score": F.col("_r") / F.nullif(F.col("_std"), F.lit(0.0))})
        return out.drop("_r", "_ape", "_sape", "_std", "z", "ape_threshold", "sape_threshold")


def anomaly_from_outliers(df: DataFrame, value: str, cutoff: float = clean.DETECTION_Z_CUTOFF, trim: float = clean.DETECTION_TRIM, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Intervals of rows far beyond the others."""
    return labels.label_to_intervals(clean.zscore_outliers(df, value, cutoff, trim, keys=keys, ts=ts), "is_outlier", keys, ts)


def merge_anomaly_sources(sources: Sequence[DataFrame], period: str, keys: Sequence[str] = ()) -> DataFrame:
    """Intervals of all sources, overlapping and adjacent ones merged."""
    every = reduce(lambda a, b: a.unionByName(b), [s.select(*keys, "start_time", "end_time") for s in sources])
    return labels.merge_intervals(every, period, keys)
