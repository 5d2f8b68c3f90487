"""Profiles, counts, histograms and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as t


def profile(df: DataFrame, within: list[str], flags: dict[str, Column]) -> DataFrame:
    """Rows and rows under each flag, in one pass."""
    return df.groupBy(*within).agg(F.count("*").alias("rows"), *[F.sum(c.cast("long")).alias(k) for k, c in flags.items()])


def dirt_flags(c: Column) -> dict[str, Column]:
    return {name: c.rlike(pattern) for name, pattern in t.DIRT_PATTERNS.items()}


def size_bucket(n: Column) -> Column:
    """0, 1-10, 11-100, 101-1000, 1001+."""
    return F.when(n == 0, "0").when(n <= 10, "1-10").when(n <= 100, "11-100").when(n <= 1000, "101-1000").otherwise("1001+")


def reasons(df: DataFrame, within: list[str], reason: Column, sample: Column, order: str) -> DataFrame:
    """Rejections by reason with their count and first sample; rows without a reason are kept rows."""
    return df.withColumn("reason", reason).where("reason is not null").groupBy(*within, "reason").agg(
        F.count("*").alias("n"), F.min_by(sample, F.col(order)).alias("sample")
    )


def flatten_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of every non-null string field, in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(key, F.inline(pairs)).where("value is not null")


def missing_probes(probes: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Expected words that are absent."""
    return probes.join(entries, keys, "left_anti")


def sum_or_null(c: Column) -> Column:
    """The sum, or null if any value is unknown."""
    return F.when(F.count(c) < F.count(F.lit(1)), None).otherwise(F.sum(c))
