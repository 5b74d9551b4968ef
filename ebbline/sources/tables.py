"""Parquet sources, sinks and the stage store."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.settings import PLACEMENT
from ebbline.sources import schema
from ebbline.sources.artefacts import file_states


@dataclass(frozen=True)
class Inputs:
    """The tables a decomposition reads."""

    daily_fact: DataFrame
    calendar: DataFrame
    campaigns: DataFrame
    dim_stay: DataFrame


def read_inputs(spark: SparkSession, folder: str) -> Inputs:
    """Read the four input tables of a folder, each checked against its schema."""
    frames = {}
    for name, want in schema.TABLES.items():
        frames[name] = schema.conform(spark.read.parquet(f"{folder}/{name}"), want)
    return Inputs(**frames)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder for stage tables that all executors share: the one that
    ``spark.checkpoint.dir`` names, else the warehouse of the session. On a cluster a warehouse
    on the driver's own disk is refused, as executors would each write to theirs."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    master = spark.conf.get("spark.master", "local")
    if not named and not master.startswith("local") and warehouse.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or warehouse).rstrip("/")


def fingerprint(*parts: DataFrame | object) -> str:
    """A name for inputs and settings: the plans of the frames, the files they read with their
    sizes and times, and the text of everything else.

    So a file written anew in place is another input. The states of the files are hashed where
    they are listed; one line comes to the driver however many there are.
    """
    digest = hashlib.sha256()
    files: set[str] = set()
    spark = None
    for part in parts:
        if isinstance(part, DataFrame):
            spark = part.sparkSession
            # the hash of the plan has 32 bits only, its text tells the rest
            plan = part._jdf.queryExecution().analyzed().canonicalized().toString()
            digest.update(repr((part.semanticHash(), plan, part.columns)).encode())
            files.update(part.inputFiles())
        else:
            digest.update(repr(part).encode())
        digest.update(b"\0")
    for file in sorted(files):
        digest.update(file.encode() + b"\n")
    if files:
        one = F.xxhash64("file", "length", "time")
        state = file_states(spark, sorted(files)).agg(F.bit_xor(one), F.sum(one % (1 << 31)), F.sum("length"))
        digest.update(repr(tuple(state.first())).encode())
    return digest.hexdigest()[:24]


# Spark's own default; a session that leaves it says nothing about its data.
_UNSET_PARTITIONS = 200


def bucket_count(spark: SparkSession) -> int:
    """The session's shuffle partitions; at the default, no more than the cores can use."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted > _UNSET_PARTITIONS:
        return wanted
    return min(wanted, 4 * spark.sparkContext.defaultParallelism)


class StageStore:
    """Writes a stage once and reads it back from then on.

    Reading back cuts the lineage, keeps column pruning, gives the optimizer true
    table sizes and survives lost executors. A stage that is ``placed`` is bucketed
    by product and stay: work on single series (windows, aggregates, joins) then
    needs no shuffle at all. Stages are tables of a database of their own, which
    ``close`` drops with their files.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.name = f"ebbline_{uuid.uuid4().hex}"
        self._tables: dict[str, str] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._names: set[str] = set()
        self._guard = threading.Lock()
        self.folder = f"{shared_folder(spark)}/{self.name}"
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{self.folder}'")

    def stage(
        self,
        name: str,
        build: Callable[[], DataFrame],
        placed: bool = False,
        buckets: list[str] | None = None,
    ) -> DataFrame:
        """The stored stage of this name, built now if it is not there; ``placed`` buckets it by
        product and stay, ``buckets`` by other columns."""
        with self._guard:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:
            if name not in self._tables:
                table = f"{self.name}.t_{hashlib.sha256(name.encode()).hexdigest()[:24]}"
                n = bucket_count(self.spark)
                # work on placed rows is placed already; other buckets get one file each
                frame = build().repartition(n, *buckets) if buckets else build()
                writer = frame.write.mode("overwrite").format("parquet")
                by = PLACEMENT if placed else buckets
                if by:
                    writer = writer.bucketBy(n, *by)
                writer.saveAsTable(table)
                self._tables[name] = table
        return self.spark.table(self._tables[name])

    def once(self, name: str) -> bool:
        """True the first time that a name is asked for."""
        with self._guard:
            new = name not in self._names
            self._names.add(name)
        return new

    def close(self) -> None:
        """Drop all stages and their files; stages asked for later are built again."""
        with self._guard:
            self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")
            self._tables.clear()
            self._names.clear()
            _STORES.pop(self.spark.sparkContext.applicationId, None)


_STORES: dict[str, StageStore] = {}


def _close_at_exit(app: str) -> None:
    """Drop the stages of an application that still runs when Python ends."""
    store = _STORES.get(app)
    if store and SparkSession.getActiveSession():
        with contextlib.suppress(Exception):
            store.close()


def store_for(spark: SparkSession) -> StageStore:
    """One store per Spark application."""
    app = spark.sparkContext.applicationId
    if app not in _STORES:
        _STORES[app] = StageStore(spark)
        atexit.register(_close_at_exit, app)
    return _STORES[app]


