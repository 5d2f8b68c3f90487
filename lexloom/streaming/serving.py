"""A table that a stream keeps current: each batch rewrites the buckets of its keys and no others.

The log under ``root`` names, for each batch and bucket, the folder that holds the bucket from then on. A batch
is written in full and then named by one appended file, so a driver lost in between leaves the state
before it, and Spark's replay of the batch writes it again. A batch that the log names is skipped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.sources.versions import BUCKET, bucket

_LOG = "batch long, bucket int, folder string"


class ServingTable:
    """Newest row of each key of a stream.

    ``order`` names the columns that make one row of a key newer than another; all other columns settle
    ties, the greatest first. A row with a true ``deleted`` column, if there is one, is a mark that its key is gone: it is
    kept, so an older row that comes late does not bring the key back, and ``rows`` leaves it out.
    Rows with a null key are no rows of any key and are left out.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, order: list[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self.newness = F.struct(*order, *sorted(c for c in schema.names if c != key and c not in order))

    def _log(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/log")

    def _folders(self, upto: int | None = None) -> dict[int, tuple[int, str]]:
        """{bucket: (batch, folder)} of the present state or of that after a batch; as many entries as buckets at most."""
        log = self._log() if upto is None else self._log().where(F.col("batch") <= upto)
        newest = log.groupBy("bucket").agg(F.max(F.struct("batch", "folder")).alias("x"))
        return {r["bucket"]: (r["x"]["batch"], r["x"]["folder"]) for r in newest.collect()}

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _live(self, df: DataFrame) -> DataFrame:
        return df.where(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in df.columns else df

    def _newest(self, df: DataFrame) -> DataFrame:
        """One row a key; a key with most of the rows is cut down inside each task before the shuffle."""
        rest = [c for c in self.schema.names if c != self.key]
        best = df.groupBy(self.key).agg(F.max_by(F.struct(*rest), self.newness).alias("_x"))
        return best.select(self.key, *[F.col("_x")[c].alias(c) for c in rest]).select(*self.schema.names)

    def refresh(self, changes: DataFrame, batch: int) -> list[int]:
        """Take a batch in; the buckets that it rewrote."""
        if self._log().where(F.col("batch") == batch).limit(1).count():
            return []
        base = f"{self.root}/data/{batch}-{uuid.uuid4().hex}"
        # The batch is reduced once; what it holds names the buckets to read.
        self._newest(changes.where(F.col(self.key).isNotNull()).select(*self.schema.names)).write.parquet(f"{base}/changes")
        came = self._read([f"{base}/changes"])
        touched = [r[0] for r in came.select(bucket(F.col(self.key), self.buckets)).distinct().collect()]
        if not touched:
            return []
        present = self._folders()
        before = self._read([present[b][1] for b in touched if b in present])
        rows = self._newest(before.unionByName(came)).withColumn(BUCKET, bucket(F.col(self.key), self.buckets))
        rows.repartition(BUCKET).sortWithinPartitions(BUCKET, self.key).write.partitionBy(BUCKET).parquet(f"{base}/rows")
        named = self.spark.createDataFrame([(batch, b, f"{base}/rows/{BUCKET}={b}") for b in touched], _LOG)
        named.coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return sorted(touched)

    def rows(self, upto: int | None = None) -> DataFrame:
        """The present rows, or those after a batch."""
        return self._live(self._read([folder for _, folder in self._folders(upto).values()]))

    def lookup(self, asked: DataFrame) -> DataFrame:
        """Rows of the keys of ``asked``; folders of other buckets are not opened."""
        wanted = {r[0] for r in asked.select(bucket(F.col(self.key), self.buckets)).distinct().collect()}
        folders = [folder for b, (_, folder) in self._folders().items() if b in wanted]
        return self._live(self._read(folders)).join(asked.select(self.key).distinct(), self.key, "left_semi")

    def emitted(self, since: int) -> DataFrame:
        """The table's columns with ``emitted`` (new, changed or gone): keys that differ from the state after batch ``since``.

        Only buckets written after it are read, in both states.
        """
        now, then = self._folders(), self._folders(since)
        moved = [b for b, (batch, _) in now.items() if batch > since]
        new = self._live(self._read([now[b][1] for b in moved]))
        old = self._live(self._read([then[b][1] for b in moved if b in then]))
        rest = [c for c in self.schema.names if c != self.key]
        pair = new.select(self.key, F.struct(*rest).alias("_new")).join(old.select(self.key, F.struct(*rest).alias("_old")), self.key, "full")
        kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").otherwise("changed")
        differs = pair.where(~F.col("_new").eqNullSafe(F.col("_old"))).withColumn("emitted", kind).withColumn("_x", F.coalesce("_new", "_old"))
        return differs.select(self.key, *[F.col("_x")[c].alias(c) for c in rest], "emitted").select(*self.schema.names, "emitted")


def keep_current(source: DataFrame, table: ServingTable, state: str) -> None:
    """Drain a stream into the table, batch by batch; ``state`` is the stream's checkpoint in a shared folder."""

    def take(batch: DataFrame, number: int) -> None:
        table.refresh(batch, number)

    source.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
