"""Events and holidays: calendars, windows, joins, effect scores, selection and grouping."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.schema import TIME, VALUE
from tidewater.staging import staged

REGULAR = ""
#: Rules of public holidays by country. (month, day), (month, weekday from Monday 0, nth; -1 last) or days from Easter.
_RULES: dict[str, dict[str, tuple]] = {
    "US": {
        "New Year's Day": ("fixed", 1, 1),
        "Martin Luther King Jr. Day": ("nth", 1, 0, 3),
        "Washington's Birthday": ("nth", 2, 0, 3),
        "Memorial Day": ("nth", 5, 0, -1),
        "Independence Day": ("fixed", 7, 4),
        "Labor Day": ("nth", 9, 0, 1),
        "Columbus Day": ("nth", 10, 0, 2),
        "Veterans Day": ("fixed", 11, 11),
        "Thanksgiving": ("nth", 11, 3, 4),
        "Christmas Day": ("fixed", 12, 25),
    },
    "GB": {
        "New Year's Day": ("fixed", 1, 1),
        "Good Friday": ("easter", -2),
        "Easter Monday": ("easter", 1),
        "May Day": ("nth", 5, 0, 1),
        "Spring Bank Holiday": ("nth", 5, 0, -1),
        "Late Summer Bank Holiday": ("nth", 8, 0, -1),
        "Christmas Day": ("fixed", 12, 25),
        "Boxing Day": ("fixed", 12, 26),
    },
    "FR": {
        "New Year's Day": ("fixed", 1, 1),
        "Easter Monday": ("easter", 1),
        "Labor Day": ("fixed", 5, 1),
        "Victory Day": ("fixed", 5, 8),
        "Ascension Day": ("easter", 39),
        "Whit Monday": ("easter", 50),
        "National Day": ("fixed", 7, 14),
        "Assumption Day": ("fixed", 8, 15),
        "All Saints' Day": ("fixed", 11, 1),
        "Armistice Day": ("fixed", 11, 11),
        "Christmas Day": ("fixed", 12, 25),
    },
    "DE": {
        "New Year's Day": ("fixed", 1, 1),
        "Good Friday": ("easter", -2),
        "Easter Monday": ("easter", 1),
        "Labor Day": ("fixed", 5, 1),
        "Ascension Day": ("easter", 39),
        "Whit Monday": ("easter", 50),
        "German Unity Day": ("fixed", 10, 3),
        "Christmas Day": ("fixed", 12, 25),
        "Second Day of Christmas": ("fixed", 12, 26),
    },
    "IN": {"Republic Day": ("fixed", 1, 26), "Independence Day": ("fixed", 8, 15), "Gandhi Jayanti": ("fixed", 10, 2), "Christmas Day": ("fixed", 12, 25)},
}


def easter(year: int) -> dt.date:
    """Easter Sunday of the Gregorian calendar."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    full_moon = epact - (epact // 28) * (1 - (epact // 28) * (29 // (epact + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + full_moon + 2 - century + century // 4) % 7
    day = full_moon - weekday
    month = 3 + (day + 40) // 44
    return dt.date(year, month, day + 28 - 31 * (month // 4))


def _date(rule: tuple, year: int) -> dt.date:
    kind, *x = rule
    if kind == "fixed":
        return dt.date(year, *x)
    if kind == "easter":
        return easter(year) + dt.timedelta(x[0])
    month, weekday, nth = x
    if nth > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (nth - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def available_countries() -> list[str]:
    return sorted(_RULES)


def available_holidays(countries: Sequence[str]) -> dict[str, list[str]]:
    return {c: sorted(_RULES[c]) for c in countries}


def holidays_across(countries: Sequence[str]) -> list[str]:
    return sorted({h for c in countries for h in _RULES[c]})


def holidays(spark: SparkSession, countries: Sequence[str], first_year: int, last_year: int) -> DataFrame:
    """(country, date, event_name) of every holiday of the years."""
    rows = [(c, _date(rule, y), name) for c in countries for y in range(first_year, last_year + 1) for name, rule in _RULES[c].items()]
    return spark.createDataFrame(rows, "country string, date date, event_name string")


def key_of(name: str) -> str:
    """A name as part of a column name."""
    return re.sub(r"[^0-9A-Za-z_]", "_", name)


def event_keys(events: DataFrame, separate: Sequence[str], other: str = "Other") -> DataFrame:
    """(event_key, date, event_name): holidays in ``separate`` by their own key, the rest together; one row per date and key."""
    key = F.when(F.col("event_name").isin(*separate), F.regexp_replace("event_name", r"[^0-9A-Za-z_]", "_")).otherwise(other)
    return events.select(key.alias("event_key"), "date", F.lit("event").alias("event_name")).distinct()


def expand_window(events: DataFrame, before: int, after: int, per_key: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The events and the days around them, as keys of their own: key_minus_1, key_plus_1 and so on."""
    spans = F.create_map(*[F.lit(x) for k, (a, b) in (per_key or {"": (0, 0)}).items() for x in (k, f"{a},{b}")])
    span = F.split(F.coalesce(F.try_element_at(spans, F.col("event_key")), F.lit(f"{before},{after}")), ",")
    offset = F.explode(F.sequence(-span[0].cast("int"), span[1].cast("int"))).alias("_o")
    moved = events.select("event_key", "date", "event_name", offset)
    name = F.when(F.col("_o") < 0, F.concat("event_key", F.lit("_minus_"), -F.col("_o"))).when(F.col("_o") > 0, F.concat("event_key", F.lit("_plus_"), "_o")).otherwise(F.col("event_key"))
    return moved.select(name.alias("event_key"), F.date_add("date", F.col("_o")).alias("date"), "event_name")


def shift_events(events: DataFrame, days: Sequence[int]) -> DataFrame:
    """The events moved by each number of days, as keys key_{n}D_after or key_{n}D_before; without the events themselves."""
    moved = events.withColumn("_o", F.explode(F.array(*[F.lit(d) for d in days])))
    side = F.when(F.col("_o") > 0, "after").otherwise("before")
    return moved.select(F.concat_ws("_", "event_key", F.concat(F.abs("_o"), F.lit("D")), side).alias("event_key"), F.date_add("date", F.col("_o")).alias("date"), "event_name")


def neighbours(impact: int | Sequence[int] | Callable[[dt.date], Sequence[dt.date]]) -> list[int]:
    """Days that an event touches: 0 .. n for a number (n .. 0 below zero), the list with 0 otherwise."""
    if isinstance(impact, int):
        return list(range(0, impact + 1)) if impact >= 0 else list(range(impact, 1))
    return sorted({0, *impact})


def add_events(df: DataFrame, events: DataFrame, keys: Sequence[str], impact: int | Sequence[int] = 0, regular: str = REGULAR, ts: str = TIME) -> DataFrame:
    """Adds events_{key} (label or ``regular``) for each key, and is_event, is_event_exact, is_event_adjacent.

    Two labels of a key on one day make two rows, as a join does. The event table is small and broadcast when Spark finds it so.
    """
    out = df.withColumn("_date", F.to_date(ts))
    touched = events.withColumn("date", F.explode(F.array(*[F.date_add("date", k) for k in neighbours(impact)]))).distinct()
    for k in keys:
        one = touched.filter(F.col("event_key") == k).select(F.col("date").alias("_date"), F.col("event_name").alias(f"events_{k}"))
        out = out.join(one, "_date", "left").withColumn(f"events_{k}", F.coalesce(f"events_{k}", F.lit(regular)))
    hit = {k: F.col(f"events_{k}") != regular for k in keys}
    some = lambda ks: F.greatest(*[hit[k].cast("int") for k in ks], F.lit(0), F.lit(0))
    near = [k for k in keys if "_minus_" in k or "_plus_" in k]
    return out.withColumns({"is_event": some(list(keys)), "is_event_exact": some([k for k in keys if k not in near]), "is_event_adjacent": some(near)}).drop("_date")


def holiday_scores(df: DataFrame, events: DataFrame, offsets: Sequence[int] = (-7, 7), relative: bool = False, tries: int = 3, ts: str = TIME, value: str = VALUE) -> DataFrame:
    """(event_key, date, score): the day's value less the mean of its baselines.

    A baseline day lies ``offset`` days off; while that is an event day itself, it moves by the offset again, up to ``tries`` times.
    """
    daily = df.groupBy(F.to_date(ts).alias("date")).agg(F.sum(value).alias("v"))
    busy = events.select(F.col("date").alias("busy")).distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.lit(n).alias("step"), F.lit(o * n).alias("off")) for k, o in enumerate(offsets) for n in range(1, tries + 2)]))
    candidates = events.select("event_key", "date", steps.alias("s")).select("event_key", "date", "s.side", "s.step", F.date_add("date", F.col("s.off")).alias("base"))
    free = candidates.join(busy, F.col("base") == F.col("busy"), "left").filter("busy is null or step = %d" % (tries + 1))
    chosen = free.groupBy("event_key", "date", "side").agg(F.min_by("base", "step").alias("base"))
    valued = chosen.join(daily.select(F.col("date").alias("base"), F.col("v").alias("b")), "base", "left")
    mean = valued.groupBy("event_key", "date").agg(F.avg("b").alias("baseline"))
    scored = mean.join(daily, "date").withColumn("score", F.col("v") - F.col("baseline"))
    if relative:
        scored = scored.withColumn("score", F.col("score") / F.nullif(F.col("baseline"), F.lit(0.0)))
    return scored.select("event_key", "date", "score")


def average_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("event_key").agg(F.avg("score").alias("avg_score"), F.count("score").alias("n_days"), (F.greatest(F.count_if(F.col("score") > 0), F.count_if(F.col("score") < 0)) / F.nullif(F.count("score"), F.lit(0))).alias("same_sign"))


def significant_events(averages: DataFrame, independent: float = 0.8, together: float = 0.99) -> DataFrame:
    """Adds role: "separate" in descending order of effect until its share of the total is covered, then "positive" or
    "negative" up to the second share, "none" beyond."""
    size = F.abs("avg_score")
    w = Window.orderBy(size.desc(), "event_key")  # one row per event
    known = averages.filter("avg_score is not null")
    ranked = known.withColumns({"_before": F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_all": F.sum(size).over(Window.partitionBy())})
    role = F.when(F.col("_before") < independent * F.col("_all"), "separate").when(F.col("_before") >= together * F.col("_all"), "none").when(F.col("avg_score") > 0, "positive").otherwise("negative")
    return ranked.withColumn("role", role).drop("_before", "_all")


def infer_holidays(df: DataFrame, spark: SparkSession, countries: Sequence[str], before: int = 2, after: int = 2, ts: str = TIME, value: str = VALUE, **share) -> DataFrame:
    """Roles of the countries' holidays and the days around them by their effect on the series."""
    span = df.agg(F.year(F.min(ts)).alias("a"), F.year(F.max(ts)).alias("b")).first()
    table = holidays(spark, countries, span.a, span.b)
    keyed = table.select(F.regexp_replace("event_name", r"[^0-9A-Za-z_]", "_").alias("event_key"), "date", F.lit("event").alias("event_name")).distinct()
    return significant_events(average_scores(holiday_scores(df, expand_window(keyed, before, after), ts=ts, value=value)), **share)


def expand_with_suffix(events: DataFrame, suffix: Callable[[Column], Column], before: int = 0, after: int = 0) -> DataFrame:
    """Events and neighbours with the kind of weekday in their keys."""
    wide = expand_window(events, before, after)
    return wide.withColumn("event_key", F.concat("event_key", suffix(F.col("date"))))


def prune_events(averages: DataFrame, min_days: int = 1, same_sign: float = 0.66, min_score: float = 0.0) -> DataFrame:
    return averages.filter((F.col("n_days") >= min_days) & (F.col("same_sign") >= same_sign) & (F.abs("avg_score") >= min_score))


def group_events(averages: DataFrame, n_clusters: int = 5, seed: int = 1) -> DataFrame:
    """Adds group: the rank of the event's cluster of effects (k-means on one number), from 0 for the lowest mean."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vector = VectorAssembler(inputCols=["avg_score"], outputCol="_x").transform(averages)
    clustered = KMeans(k=n_clusters, seed=seed, featuresCol="_x", predictionCol="_c").fit(vector).transform(vector).drop("_x")
    means = clustered.groupBy("_c").agg(F.avg("avg_score").alias("_m")).withColumn("group", F.dense_rank().over(Window.orderBy("_m")) - 1)
    return clustered.join(means.select("_c", "group"), "_c").drop("_c")


def group_by_density(averages: DataFrame, keys: Sequence[str] = (), bandwidth: float | None = None, multiplier: float = 0.2) -> DataFrame:
    """Adds group: events of similar effect, cut at 0 and at the valleys of the effects' density, numbered from 0 for the lowest.

    The density (Gaussian kernels) is looked at where events are: an effect whose density is below that of both its
    neighbours is a valley, and belongs to the group below. Without ``bandwidth`` it is 0.9 min(deviation, quartile
    range / 1.34) n^(-1/5) of the distinct effects times ``multiplier``; where that is 0 only 0 cuts. A series' effects are
    one array: as many numbers as it has kinds of events. Events without an effect have no group.
    """
    # effects are compared with cuts that are effects themselves: both have to be the same numbers
    averages = staged(averages, "effects")
    score = F.col("avg_score").cast("double")
    distinct = averages.filter(score.isNotNull()).select(*keys, score.alias("_s")).distinct()
    spread = F.least(F.stddev_pop("_s"), (F.percentile("_s", F.lit(0.75)) - F.percentile("_s", F.lit(0.25))) / 1.34)
    rule = F.lit(float(bandwidth)) if bandwidth is not None else 0.9 * spread * F.pow(F.count("*"), F.lit(-0.2)) * multiplier
    shape = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_x"), F.nullif(rule, F.lit(0.0)).alias("_h"))
    density = F.transform("_x", lambda x: F.aggregate("_x", F.lit(0.0), lambda a, y: a + F.exp(-0.5 * F.pow((x - y) / F.col("_h"), F.lit(2.0)))))
    shape = shape.withColumn("_d", density)
    low = lambda x, i: (i > 0) & (i < F.size("_x") - 1) & (F.get("_d", i) < F.get("_d", i - 1)) & (F.get("_d", i) < F.get("_d", i + 1))
    shape = shape.withColumn("_cuts", F.array_union(F.filter("_x", low), F.array(F.lit(0.0)))).select(*keys, "_cuts")
    met = averages.join(shape, list(keys)) if keys else averages.crossJoin(F.broadcast(shape))  # one row
    part = F.when(score.isNotNull(), F.size(F.filter("_cuts", lambda c: c < score)))
    own = Window.partitionBy(*keys, score.isNull()).orderBy("_part")
    return met.withColumn("_part", part).withColumn("group", F.when(F.col("_part").isNotNull(), F.dense_rank().over(own) - 1)).drop("_part", "_cuts")


def event_terms(keys: Sequence[str]) -> Iterator[str]:
    for k in keys:
        yield f"events_{k}"
