"""Keyed models on disk: a folder of parquet tables beside a JSON description, readable in any session."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import series_models
from tidewater.operators.linear_model import ModelSpec
from tidewater.operators.series_models import SeriesModels
from tidewater.sources.tables import dumps, loads
from tidewater.schema import TIME, VALUE

#: Grows when a saved folder can't be read as before.
VERSION = 1
_TABLES = ("design", "table", "train", "events", "slices", "fallback")


def save_series_models(models: SeriesModels, path: str) -> None:
    """Write models to a new folder of any file system of the session: their description, and their tables side by side."""
    spark = models.table.sparkSession
    tables = dict(zip(_TABLES, (models.staged[0], models.table, models.train, models.events, models.slices, models.fallback), strict=True))
    for name, t in tables.items():
        if t is not None:
            t.write.parquet(f"{path}/{name}")
    about = {"version": VERSION, "spec": dumps(models.spec), "keys": models.keys, "names": models.names, "tables": [n for n, t in tables.items() if t is not None]}
    # last: a folder without it isn't a model
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")


def load_series_models(spark: SparkSession, path: str, ts: str = TIME, value: str = VALUE) -> SeriesModels:
    """Read saved models; they predict as they did. Folders of another version are an error."""
    about = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/about").collect()))
    if about["version"] != VERSION:
        raise ValueError(f"saved by version {about['version']}, this is version {VERSION}")
    found: dict[str, DataFrame] = {n: spark.read.parquet(f"{path}/{n}") for n in about["tables"]}
    spec, keys = loads(about["spec"], [ModelSpec]), about["keys"]
    # columns are expressions: they are made again from the specification and the training rows
    origins = found["table"].select(*keys, *[F.col(c) for c in ("_origin", "_first", "_last", "_known")])
    _, columns = series_models.design_table(found["train"], spec, origins, keys, found.get("events"), ts, value)
    if list(columns) != about["names"]:
        raise ValueError("the saved columns can't be made again from the training rows")
    return SeriesModels(spec, keys, columns, found["table"], found["train"], found.get("events"), found.get("slices"), found.get("fallback"), [found["design"]])
