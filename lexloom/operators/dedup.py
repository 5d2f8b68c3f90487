"""First-wins and exact-record deduplication, key checks, samples and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: str, accepted: Column | None = None) -> DataFrame:
    """The first accepted row of each key; pre-aggregated, so a hot key is one row per task."""
    rows = df if accepted is None else df.where(accepted)
    row = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.min_by(row, F.col(order)).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of a record's canonical JSON; set-like columns should be sorted by the caller."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def exact_records(df: DataFrame, digest: Column, order: str) -> DataFrame:
    """(digest, first, copies): first row and number of rows of each distinct record."""
    return df.select(digest.alias("digest"), F.col(order)).groupBy("digest").agg(
        F.min(order).alias("first"), F.count("*").alias("copies")
    )


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row bears."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def bottom_k(df: DataFrame, within: list[str], digest: Column, k: int) -> DataFrame:
    """The k rows of least digest in each group; limited per task before the shuffle."""
    w = W.partitionBy(*within).orderBy("digest")
    return df.withColumn("digest", digest).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows drawn by a seeded hash: the same whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def set_fingerprint(df: DataFrame, within: list[str], digest: Column) -> DataFrame:
    """An order-insensitive digest of each group, in two levels.

    Distinct digests are cut by their first byte into 256 parts; parts are hashed in parallel and the
    part hashes once more, so no task holds a whole group.
    """
    rows = df.select(*within, digest.alias("d")).distinct().withColumn("part", F.substring("d", 1, 2))
    parts = rows.groupBy(*within, "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("h"), F.count("*").alias("n"))
    return parts.groupBy(*within).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("digest"),
        F.sum("n").alias("members"),
    )


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, as (columns, side)."""
    return a.distinct().join(b, a.columns, "left_anti").withColumn("side", F.lit("removed")).unionByName(
        b.distinct().join(a, a.columns, "left_anti").withColumn("side", F.lit("added"))
    )
