"""Stored models as whole artefacts: tables with a manifest that is written last.

The manifest names the format, the settings, and for every table its schema and its files with
their sizes and times. A folder without one is a half-written model; one whose files differ
from it was changed since. Neither is ever read as a model.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Raised whenever tables written before can no longer be read as they are meant.
FORMAT = 1
MANIFEST = "manifest"


def file_states(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, length and time (milliseconds) of Parquet files and of those in folders; their
    contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([unquote(p) for p in paths])
    return found.select(
        F.col("path").alias("file"), "length", F.unix_millis("modificationTime").alias("time")
    )


def _listed(spark: SparkSession, folder: str, names: list[str]) -> dict[str, list[list]]:
    """The files of each table; a model has a few files per factor."""
    parts = F.split("file", "/")
    states = file_states(spark, [f"{folder}/{n}" for n in names]).select(
        F.try_element_at(parts, F.lit(-2)).alias("table"), F.try_element_at(parts, F.lit(-1)).alias("file"), "length", "time"
    )
    found: dict[str, list[list]] = {n: [] for n in names}
    for r in states.collect():
        found[r.table].append([r.file, r.length, r.time])
    return {n: sorted(files) for n, files in found.items()}


def save(folder: str, tables: dict[str, DataFrame], settings: str) -> None:
    """Write the tables under their names, and the manifest once all of them are there."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    files = _listed(spark, folder, list(tables))
    told = {
        "format": FORMAT,
        "settings": settings,
        "tables": {n: {"schema": t.schema.jsonValue(), "files": files[n]} for n, t in tables.items()},
    }
    line = spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1)
    line.write.mode("overwrite").text(f"{folder}/{MANIFEST}")


def load(
    spark: SparkSession, folder: str, names: list[str], settings: str | None = None
) -> dict[str, DataFrame]:
    """The tables of a saved model, each read with its recorded schema."""
    try:
        lines = spark.read.text(f"{folder}/{MANIFEST}").collect()
    except AnalysisException as error:
        raise ValueError(f"{folder} has no manifest; the model was not written to its end") from error
    try:
        told = json.loads(lines[0].value)
        version, tables = told["format"], told["tables"]
    except (IndexError, KeyError, TypeError, json.JSONDecodeError) as error:
        raise ValueError(f"{folder} has a manifest that cannot be read") from error
    if version != FORMAT:
        raise ValueError(f"{folder} has format {version}, this library reads {FORMAT}")
    if settings is not None and told["settings"] != settings:
        raise ValueError(f"{folder} was fitted with other settings: {told['settings']}")
    absent = [n for n in names if n not in tables]
    if absent:
        raise ValueError(f"{folder} lacks {', '.join(absent)}")
    try:
        files = _listed(spark, folder, names)
    except AnalysisException as error:
        raise ValueError(f"{folder} lacks a table of its manifest") from error
    changed = [n for n in names if files[n] != sorted(tables[n]["files"])]
    if changed:
        raise ValueError(f"{folder} was changed after it was saved: {', '.join(changed)}")
    return {
        n: spark.read.schema(T.StructType.fromJson(tables[n]["schema"])).parquet(f"{folder}/{n}") for n in names
    }
