"""Readers of series and of hierarchies, and model files."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.timegrid import AGGREGATES, resample
from tidewater.schema import TIME


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """A CSV file or folder with a header; with a schema nothing is read to find one."""
    reader = spark.read.options(header=True, **options)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder by name: parquet, else CSV. The session's file systems decide what a folder is."""
    for suffix, read in ((".parquet", spark.read.parquet), (".csv", lambda p: read_csv(spark, p))):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}{suffix}")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return read(f"{folder}/{name}{suffix}")
    raise FileNotFoundError(f"{folder}/{name}")


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(s.getPath().getName().rsplit(".", 1)[0] for s in found if s.getPath().getName().endswith((".parquet", ".csv")))


def aggregated(df: DataFrame, freq: str, aggs: dict[str, str], keys: Sequence[str] = (), ts: str = TIME) -> DataFrame:
    """Resampled by calendar: hourly, daily, weekly (to Monday) or monthly, an aggregate by name for each column."""
    bins = {"hourly": "H", "daily": "D", "weekly": "W-MON", "monthly": "MS"}
    return resample(df, bins.get(freq, freq), {c: AGGREGATES[a](F.col(c)) for c, a in aggs.items()}, keys, ts)


def timestamp_from_parts(year: str, month: str, day: str, hour: str) -> Column:
    return F.make_timestamp_ntz(F.col(year), F.col(month), F.col(day), F.col(hour), F.lit(0), F.lit(0))


def mean_of_meters(df: DataFrame, value: str, meter: str | None = None, meter_col: str = "meter", ts: str = TIME) -> DataFrame:
    """One meter's series, or the mean over all."""
    if meter is not None:
        return df.filter(F.col(meter_col) == meter).select(ts, value)
    return df.groupBy(ts).agg(F.avg(value).alias(value))


# ---- models as JSON


def _plain(x: Any) -> Any:
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return {"__type__": type(x).__name__, **{f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    if isinstance(x, np.ndarray):
        return {"__array__": x.tolist()}
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, (dt.datetime, dt.date)):
        return {"__time__" if isinstance(x, dt.datetime) else "__date__": x.isoformat()}
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, (str, int, float, bool)) or x is None:
        return x
    raise TypeError(f"{type(x).__name__} can't be written as JSON")


def dumps(model: Any) -> str:
    """A dataclass of plain values and arrays as JSON."""
    return json.dumps(_plain(model))


def loads(text: str, types: Sequence[type]) -> Any:
    """The value that dumps wrote; ``types`` are the dataclasses that may occur."""
    by_name = {t.__name__: t for t in types}

    def build(x: Any) -> Any:
        if isinstance(x, dict) and "__array__" in x:
            return np.array(x["__array__"])
        if isinstance(x, dict) and "__type__" in x:
            return by_name[x["__type__"]](**{k: build(v) for k, v in x.items() if k != "__type__"})
        if isinstance(x, dict) and ("__time__" in x or "__date__" in x):
            return dt.datetime.fromisoformat(x["__time__"]) if "__time__" in x else dt.date.fromisoformat(x["__date__"])
        if isinstance(x, dict):
            return {k: build(v) for k, v in x.items()}
        return [build(v) for v in x] if isinstance(x, list) else x

    return build(json.loads(text))


def save_model(spark: SparkSession, model: Any, path: str) -> None:
    """Write a model as one JSON file to any file system of the session."""
    spark.createDataFrame([(dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str, types: Sequence[type]) -> Any:
    return loads("\n".join(r.value for r in spark.read.text(path).collect()), types)
