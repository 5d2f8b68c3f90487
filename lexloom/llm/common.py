"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import checkpoint_dir

#: Rows of a written table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS = 200_000

#: Words of the contracts: runs of anything but space, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


class Memo(dict):
    """word -> made(word), emptied whenever it holds ``limit`` entries, so memory is bounded."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Recent(dict):
    """key -> made(key) with at most ``limit`` entries: half of them new, half from before, which come back when asked for."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.half, self.before = make, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self.before.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


#: What a Python worker keeps from task to task, by name.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable):
    """One ``make()`` per Python worker; workers are reused across tasks."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def forget(but: str | None = None) -> None:
    """Free what an earlier stage's tasks left in this worker, which later stages would carry along."""
    stale = [name for name in _kept if name != but]
    for name in stale:
        del _kept[name]
    if stale:
        gc.collect()


def map_texts(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[..., dict[str, Iterable]]],
    schema: str,
    arrow: pa.Schema,
    keeps: str | None = None,
) -> DataFrame:
    """Arrow-batched map of the named columns.

    ``make`` runs once per task and gives a function from the columns' lists to a dict of
    output columns; only the named columns leave the scan, so extra columns of any name are
    neither read nor able to clash. ``keeps`` names what a worker keeps for the next task of this map.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                out = f(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[field.name], type=field.type) for field in arrow], schema=arrow
                )

    return df.select(*columns).mapInArrow(run, schema)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Intermediate tables of one run: Parquet in the folder that the cluster shares.

    A written table cuts the lineage as a checkpoint does, but is compressed and read by column. ``drop``
    deletes tables after their last reader; what a returned plan still reads has to stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        path, self.count = f"{self.base}/{self.count}", self.count + 1
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._written = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._written)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        # Shuffle files of plans that nothing refers to go when the driver's JVM collects them.
        jvm.System.gc()


def sized(df: DataFrame, most: int) -> DataFrame:
    """The written table as a broadcast side if it has at most ``most`` rows; else it is shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def once_per_id(rows: DataFrame, tables: Tables) -> DataFrame:
    """(id, text) with one row an id, of repeated ids that of the smallest text; only their texts are shuffled."""
    twice = rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    if not twice.limit(1).count():
        return rows
    twice = tables.write(twice)
    once = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return rows.join(twice, "id", "left_anti").unionByName(tables.write(once))


#: Freed memory goes back to the system: without a fixed threshold, glibc keeps blocks of up to 32 MB.
MALLOC = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2"}


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package beside the driver's copy of it, if it isn't installed, and hold little memory that is free."""
    for name, value in MALLOC.items():
        spark.sparkContext.environment.setdefault(name, value)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of at most so many rows, which bounds a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_sample(df: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``n`` ids' rows, chosen by a hash of the id: the same whatever the partitioning.

    Only ids are ranked (top-n per task, then merged); the ``n`` chosen ids are the broadcast side,
    so its size is bounded by ``n``. Used to fit models alone, never to report on the corpus.
    """
    ids = df.select(F.col(id_col).alias("_sampled")).where(F.col("_sampled").isNotNull()).distinct()
    ids = ids.orderBy(F.xxhash64(F.col("_sampled"), F.lit(11)), "_sampled").limit(n)
    return df.join(F.broadcast(ids), F.col(id_col) == F.col("_sampled"), "left_semi")
