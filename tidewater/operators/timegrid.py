"""Time grids: resampling, gap filling, gaps, statistics, canonical form, splits and future frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.schema import DAY_SECONDS, TIME, VALUE, finite, simple_frequency

#: Named aggregates of a value column.
AGGREGATES: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "nanmean": F.avg, "median": F.median, "sum": F.sum, "minimum": F.min, "maximum": F.max, "count": F.count}


def weighted_average(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def bin_start(ts: Column, freq: str, origin: Column | None = None) -> Column:
    """Label of the bin that a time falls into. H, D, MS: its start. W-MON: the Monday that ends the week (Tuesday to
    Monday). nD: start of the n-day bin counted from the day of ``origin``."""
    if freq in ("H", "D", "MS"):
        return F.date_trunc({"H": "HOUR", "D": "DAY", "MS": "MONTH"}[freq], ts).cast("timestamp_ntz")
    if freq == "W-MON":
        return F.date_add(F.to_date(ts), (7 - F.weekday(ts)) % 7).cast("timestamp_ntz")
    if freq.endswith("D") and freq[:-1].isdigit():
        n, first = int(freq[:-1]), F.to_date(origin)
        return F.date_add(first, (F.floor(F.date_diff(F.to_date(ts), first) / n) * n).cast("int")).cast("timestamp_ntz")
    raise ValueError(f"unknown frequency {freq}")


def resample(df: DataFrame, freq: str, aggs: dict[str, Column], keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """One row per bin that has rows, with the given aggregates; partial sums run before the shuffle."""
    origin = None
    if freq.endswith("D") and freq != "D":
        first = df.groupBy(*keys).agg(F.min(ts).alias("_first"))
        df = df.crossJoin(F.broadcast(first)) if not keys else df.join(first, list(keys))
        origin = F.col("_first")
    return df.groupBy(*keys, bin_start(F.col(ts), freq, origin).alias(TIME)).agg(*[c.alias(k) for k, c in aggs.items()])


def drop_incomplete_bins(df: DataFrame, freq: str, per_bin: int, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Without the first and last bin of each series where it has fewer than ``per_bin`` rows."""
    binned = df.withColumn("_bin", bin_start(F.col(ts), freq))
    sizes = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    edge = Window.partitionBy(*keys)
    bad = sizes.withColumns({"_lo": F.min("_bin").over(edge), "_hi": F.max("_bin").over(edge)}).filter(((F.col("_bin") == F.col("_lo")) | (F.col("_bin") == F.col("_hi"))) & (F.col("_n") < per_bin))
    return binned.join(bad.select(*keys, "_bin"), [*keys, "_bin"], "left_anti").drop("_bin")


def time_grid(df: DataFrame, interval: str, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Every grid time between the first and last time of each series."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).filter("_a is not null")
    return span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval {interval}"))).alias(ts))


def fill_gaps(df: DataFrame, interval: str, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """The rows on the grid, with null rows where there are none; rows off the grid go."""
    return time_grid(df, interval, keys, ts).join(df, [*keys, ts], "left")


def fill_gap_counts(df: DataFrame, interval: str, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Per series: times added by fill_gaps and times dropped by it."""
    grid = time_grid(df, interval, keys, ts).withColumn("_grid", F.lit(1))
    both = grid.join(df.select(*keys, ts).distinct().withColumn("_data", F.lit(1)), [*keys, ts], "full")
    return both.groupBy(*keys).agg(F.count_if(F.col("_data").isNull()).alias("added"), F.count_if(F.col("_grid").isNull()).alias("dropped"))


def gap_seconds(ts: Column, before: Column) -> Column:
    """Seconds between two times, to the microsecond."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(ts) - micros(before)) / 1e6


def with_gaps(df: DataFrame, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumn("delta_sec", gap_seconds(F.col(ts), F.lag(ts).over(w)))


def find_gaps(df: DataFrame, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """(before, after, gap_size) where more than the smallest gap lies between two times; size in missing periods."""
    w = Window.partitionBy(*keys)
    gaps = df.select(*keys, ts).withColumn("after", F.lead(ts).over(w.orderBy(ts))).withColumn("_gap", gap_seconds(F.col("after"), F.col(ts)))
    gaps = gaps.withColumn("_least", F.min("_gap").over(w)).filter("_gap > _least")
    return gaps.select(*keys, F.col(ts).alias("before"), "after", (F.col("_gap") / F.nullif(F.col("_least"), F.lit(0.0)) - 1).alias("gap_size"))


def min_gap_seconds(df: DataFrame, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    return with_gaps(df, keys, ts).groupBy(*keys).agg(F.min("delta_sec").alias("min_gap"))


def time_stats(df: DataFrame, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Rows, first and last time, gaps (mean, median, smallest, largest) and whether all are equal."""
    return (
        with_gaps(df.select(*keys, ts), keys, ts)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("data_points"),
            F.min(ts).alias("min_timestamp"),
            F.max(ts).alias("max_timestamp"),
            F.avg("delta_sec").alias("mean_delta"),
            F.median("delta_sec").alias("median_delta"),
            F.min("delta_sec").alias("min_delta"),
            F.max("delta_sec").alias("max_delta"),
            (F.min("delta_sec") == F.max("delta_sec")).alias("regular_increments"),
        )
    )


def dedupe_keep_first(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """One row per time, the first in the given order."""
    w = Window.partitionBy(*keys, ts).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


#: Names of regular spacings by their seconds.
_BY_SECONDS = {1: "S", 60: "min", 3600: "H", 86400: "D", 7 * 86400: "W"}


def infer_frequency(df: DataFrame, ts: str = TIME) -> str | None:
    """Name of the spacing that all times of one series keep, calendar steps included; None if there is none."""
    steps = with_gaps(df.select(ts).distinct(), (), ts).filter("delta_sec is not null")
    days = F.dayofmonth(ts)
    w = Window.orderBy(ts)
    months = (F.year(ts) * 12 + F.month(ts)) - F.lag(F.year(ts) * 12 + F.month(ts)).over(w)
    r = df.select(ts).distinct().withColumns({"_m": months, "_first": days == 1, "_last": F.to_date(ts) == F.last_day(ts)}).agg(F.min("_m").alias("m0"), F.max("_m").alias("m1"), F.bool_and("_first").alias("first"), F.bool_and("_last").alias("last"), F.date_format(F.min(ts), "EEE").alias("day")).first()
    g = steps.agg(F.min("delta_sec").alias("a"), F.max("delta_sec").alias("b")).first()
    if g.a is None:
        return None
    if g.a == g.b:
        if g.a in _BY_SECONDS:
            return _BY_SECONDS[g.a] if g.a != 7 * 86400 else f"W-{r.day.upper()}"
        for unit, name in ((86400, "D"), (3600, "H"), (60, "min"), (1, "S")):
            if g.a % unit == 0:
                return f"{int(g.a // unit)}{name}"
    if r.m0 == r.m1 and r.m0 in (1, 3, 12) and (r["first"] or r["last"]):
        return {1: "M", 3: "Q", 12: "Y"}[r.m0] + ("S" if r["first"] else "E")
    return None


@dataclass
class Canonical:
    """A series in canonical form and what was found on the way."""

    df: DataFrame
    fit_df: DataFrame
    train_end: object
    last_value: object
    added: int
    dropped: int


def canonicalise(df: DataFrame, interval: str, time_col: str = TIME, value_col: str = VALUE, train_end: object = None, regressors: Sequence[str] = (), anomalies: DataFrame | None = None) -> Canonical:
    """One series, renamed to ts and y, deduplicated (first row of a time), gap-filled, infinities null, cut at train_end.

    train_end defaults to the last time with a value (with regressors: no later than the last with any of those);
    one beyond the data is brought back to it. ``anomalies`` are applied last (see clean.adjust_intervals).
    """
    from tidewater.operators.clean import adjust_intervals

    known = [r for r in regressors if r in df.columns]
    base = df.select(F.col(time_col).cast("timestamp_ntz").alias(TIME), F.col(value_col).alias(VALUE), *known).withColumn("_at", F.monotonically_increasing_id())
    if base.limit(3).count() < 3:
        raise ValueError("a series needs more than two rows")
    single = dedupe_keep_first(base, ["_at"]).drop("_at")
    counts = fill_gap_counts(single, interval).first()
    full = fill_gaps(single, interval).withColumn(VALUE, finite(VALUE))
    present = F.coalesce(*[F.col(r).cast("string") for r in known]).isNotNull() if known else F.lit(True)
    last = full.agg(F.max(F.when(F.col(VALUE).isNotNull(), F.col(TIME))).alias("y"), F.max(F.when(present, F.col(TIME))).alias("r"), F.max(TIME).alias("t")).first()
    end = last.y if not known or last.r is None else min(last.y, last.r)
    if train_end is not None and train_end <= last.t:
        end = train_end
    if anomalies is not None:
        full = adjust_intervals(full, anomalies, [VALUE])
    return Canonical(full, full.filter(F.col(TIME) <= F.lit(end)), end, last.y, counts.added if counts else 0, counts.dropped if counts else 0)


def future_frame(df: DataFrame, interval: str, periods: int, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """The next ``periods`` times of each series."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("_t"))
    step = F.expr(f"interval {interval}")
    return last.select(*keys, F.explode(F.sequence(F.col("_t") + step, F.col("_t") + step * periods, step)).alias(ts))


def train_test_split(df: DataFrame, test_periods: int, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Adds is_test: the last ``test_periods`` rows of each series."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("is_test", F.row_number().over(w) <= test_periods)


def history_days(df: DataFrame, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Days of history, the last period counted in full, and the simple frequency."""
    stats = time_stats(df, keys, ts)
    days = (gap_seconds(F.col("max_timestamp"), F.col("min_timestamp")) + F.col("median_delta")) / DAY_SECONDS
    return stats.select(*keys, days.alias("num_training_days"), F.col("median_delta").alias("period"), F.col("data_points"))


def default_horizon(period_seconds: float, n: int) -> int:
    """The frequency's usual horizon, at most half the observations."""
    return min(simple_frequency(period_seconds).horizon, n // 2)


def block_index(n_col: str, rank: Column, size: int, complete: str = "last") -> Column:
    """Number of the block of ``size`` rows that a row (rank from 1) falls into; the last block is complete, or the first."""
    n = F.col(n_col)
    offset = (size - n % size) % size if complete == "last" else F.lit(0)
    return F.floor((rank - 1 + offset) / size).cast("long")


def aggregate_from_end(df: DataFrame, size: int, agg: str = "sum", keys: Sequence[str] = (), ts: str = TIME, value: str = VALUE) -> DataFrame:
    """Bins of ``size`` rows counted from the end; a leading remainder goes, unless it is all there is."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(F.col(ts).desc())) - 1, "_n": F.count("*").over(w)})
    bins = ranked.withColumn("_bin", F.floor(F.col("_r") / size)).filter((F.col("_bin") < F.floor(F.col("_n") / size)) | (F.col("_n") < size))
    out = bins.groupBy(*keys, "_bin").agg(F.min(ts).alias(ts), AGGREGATES[agg](F.col(value)).alias(value))
    return out.drop("_bin")


def partition_future(train: DataFrame, future: DataFrame, interval: str, keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """(keys, ts, part): rows of ``future`` as before, inside or after the training times of their series, and the grid
    times between the last training time and the first row after it as gap: a recursive forecast passes through them.

    Series without training rows have part null; repeated rows stay.
    """
    span = train.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    joined = future.select(*keys, ts).join(span, list(keys), "left") if keys else future.select(ts).crossJoin(F.broadcast(span))  # one row
    t = F.col(ts)
    placed = joined.withColumn("part", F.when(t < F.col("_a"), "before").when(t <= F.col("_b"), "inside").when(t > F.col("_b"), "after"))
    first = placed.filter("part = 'after'").groupBy(*keys, "_b").agg(F.min(ts).alias("_first"))
    step = F.expr(f"interval {interval}")
    gap = first.filter(F.col("_b") + step < F.col("_first")).select(*keys, F.explode(F.sequence(F.col("_b") + step, F.col("_first"), step)).alias(ts), "_first")
    return placed.select(*keys, ts, "part").unionByName(gap.filter(t < F.col("_first")).select(*keys, ts, F.lit("gap").alias("part")))
