"""Versioned sets of tables, published whole or not at all.

A set is written to a folder of its own, read back and held against what was written (rows, an
order-free digest, the caller's checks), and only then named in the table of versions: that one
appended row is the publication. A driver lost at any point before leaves the version before it current,
and its unnamed folder is never read. Retiring a version is a row as well, written before its folder goes.

Tables may be cut into buckets by the hash of a key: folders that ``lookup`` opens only if an asked
key is in them. Inside a bucket rows are sorted by the given columns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKET = "_bucket"
#: Tables of a version that are written at the same time.
SIDE_BY_SIDE = 4
_ROW = "label string, base string, at timestamp, status string, tables map<string,struct<rows:long,digest:string,key:string,buckets:int,schema:string>>"


@dataclass
class Layout:
    """Rows of one table; ``key`` names the column whose hash picks the bucket, where ``distinct`` rows lose their repeats."""

    rows: DataFrame
    key: str | None = None
    buckets: int = 1
    order: list[str] = field(default_factory=list)
    distinct: bool = False


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _measures(df: DataFrame) -> list[Column]:
    """Row count and an order-free digest of all columns."""
    names = sorted(c for c in df.columns if c != BUCKET)
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias("digest")]


class Table:
    """A published table: its rows, and the rows of asked keys."""

    def __init__(self, df: DataFrame, key: str | None, buckets: int):
        self.df, self.key, self.buckets = df, key, buckets

    def rows(self) -> DataFrame:
        return self.df.drop(BUCKET)

    def lookup(self, asked: DataFrame, column: str) -> DataFrame:
        """Rows joined to ``asked`` on the key; other buckets' folders are not opened.

        The driver sees at most ``buckets`` numbers.
        """
        wanted = [r[0] for r in asked.select(bucket(F.col(column), self.buckets)).distinct().collect() if r[0] is not None]
        found = self.df.where(F.col(BUCKET).isin(wanted)).drop(BUCKET)
        return found.join(asked.withColumnRenamed(column, self.key), self.key)


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> DataFrame:
        path, fs = self._path(f"{self.root}/versions")
        if not fs.exists(path):
            return self.spark.createDataFrame([], _ROW)
        return self.spark.read.schema(_ROW).parquet(f"{self.root}/versions")

    def _say(self, label: str, base: str, status: str, tables: dict) -> None:
        row = self.spark.createDataFrame([(label, base, None, status, tables)], _ROW).withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/versions")

    def published(self) -> DataFrame:
        """(label, base, at, tables) of versions that are not retired."""
        log = self._log()
        gone = log.where("status = 'retired'").select("base")
        return log.where("status = 'published'").join(gone, "base", "left_anti").select("label", "base", "at", "tables")

    def publish(self, label: str, tables: dict[str, Layout], check: Callable[[dict[str, DataFrame]], list[str]] | None = None) -> dict[str, Table]:
        """Write, validate and name a version; raises and leaves the current one if a check fails."""
        base = f"{self.root}/data/{uuid.uuid4().hex}"

        def write(name: str) -> tuple[str, tuple, list[str]]:
            layout = tables[name]
            rows = layout.rows
            if layout.key:
                rows = rows.withColumn(BUCKET, bucket(F.col(layout.key), layout.buckets)).repartition(BUCKET)
                rows = (rows.distinct() if layout.distinct else rows).sortWithinPartitions(BUCKET, *layout.order)
            seen = Observation()
            writer = rows.observe(seen, *_measures(rows)).write
            (writer.partitionBy(BUCKET) if layout.key else writer).parquet(f"{base}/{name}")
            did = (int(seen.get["rows"]), str(seen.get["digest"]), layout.key, layout.buckets, layout.rows.schema.json())
            return name, did, self._differs(name, self._open(base, {name: did})[name].df, did)

        # The tables' jobs run side by side, which fills executors that one small table would leave idle.
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            done = list(pool.map(write, tables))
        wrote, problems = {n: w for n, w, _ in done}, [p for *_, found in done for p in found]
        found = self._open(base, wrote)
        problems += check({n: t.rows() for n, t in found.items()}) if check and not problems else []
        if problems:
            raise ValueError(f"version {label} is not valid: {'; '.join(problems)}")
        self._say(label, base, "published", wrote)
        return found

    @staticmethod
    def _differs(name: str, df: DataFrame, wrote: tuple) -> list[str]:
        got = df.agg(*_measures(df)).first()
        return [] if (int(got["rows"]), str(got["digest"])) == tuple(wrote[:2]) else [f"{name}: {got['rows']} rows read, {wrote[0]} written, or other contents"]

    def _open(self, base: str, tables: dict) -> dict[str, Table]:
        out = {}
        for name, (_, _, key, buckets, shape) in tables.items():
            fields = StructType.fromJson(json.loads(shape)).fields + ([StructField(BUCKET, IntegerType())] if key else [])
            out[name] = Table(self.spark.read.schema(StructType(fields)).parquet(f"{base}/{name}"), key, buckets)
        return out

    def current(self, label: str | None = None) -> dict[str, Table] | None:
        """Tables of the newest version, of the label if one is given; None if there is none."""
        rows = self.published()
        rows = rows if label is None else rows.where(F.col("label") == label)
        newest = rows.agg(F.max_by(F.struct("base", "tables"), F.struct("at", "base")).alias("x")).first()["x"]
        return newest and self._open(newest["base"], {n: tuple(t) for n, t in newest["tables"].items()})

    def bring(self, label: str, manifest: dict, tables: dict[str, Layout]) -> dict[str, Table]:
        """Publish tables read from elsewhere if they are what their manifest says: rows and digest by name."""

        def check(found):
            missing = [f"{n}: not in the manifest" for n in found if n not in manifest] + [f"{n}: missing" for n in manifest if n not in found]
            return missing or [p for n, df in found.items() for p in self._differs(n, df, manifest[n])]

        return self.publish(label, tables, check)

    def prune(self, keep: int) -> list[str]:
        """Retire all but the newest ``keep`` versions of each label and delete their folders; safe to run again."""
        order = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("at"), F.desc("base")))
        old = [r["base"] for r in self.published().withColumn("r", order).where(F.col("r") > keep).collect()]
        for base in old:
            self._say("", base, "retired", {})
        gone = [r["base"] for r in self._log().where("status = 'retired'").select("base").distinct().collect()]
        for base in gone:
            path, fs = self._path(base)
            if fs.exists(path):
                fs.delete(path, True)
        return old


def source_label(df: DataFrame) -> str:
    """One text for the files behind a table: names, sizes and times of change, so a changed source has another."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("*").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"
