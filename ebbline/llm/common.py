"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the blanks that part words, \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``; where that is unset, the warehouse
    of the session, which every executor reaches as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/corpus"


def write(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Write a table; shuffle files of the job go once it is written."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEAN_UP, before)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a stage to the shared folder and read it back: short lineage, and lost
    executors lose nothing. Each call takes a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write(df, path, compression)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text, cut at BLANKS; none for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def by_slices(
    work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], rows: int = 256
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that hands on a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                made = work(batch.slice(at, rows))
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made

    return run
