"""Point reads over installed and published records: by name with precedence, by id, by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as t


def record_cascade(asked: DataFrame, installed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(lang, name, place, record): each asked (lang, name) once, from the installed records, else from the published chunks.

    Both tables have (lang, name, record), names in lower case, at most one row a name; ``chunks`` also
    ``letter``, by which it is partitioned. Only names that are not installed meet the chunks, and by letter
    as well, so that chunks of other letters are pruned. ``place`` is 'installed', 'chunk', or null
    if the name is nowhere. Null languages and names meet nothing.
    """
    names = asked.select("lang", F.lower("name").alias("name")).distinct()
    here = names.join(installed.select("lang", "name", F.col("record").alias("_record"), F.lit("installed").alias("place")), ["lang", "name"], "left")
    missing = here.where("place is null").select("lang", "name", t.chunk_letter(F.col("name")).alias("letter"))
    there = missing.join(chunks.select("lang", "name", "letter", F.col("record").alias("_record"), F.lit("chunk").alias("place")), ["lang", "letter", "name"], "left").drop("letter")
    both = here.where("place is not null").unionByName(there)
    return both.select("lang", "name", "place", F.col("_record").alias("record"))


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of a list of ids, each once however often an id is asked."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def first_names(rows: DataFrame, version: Column, order: list[str], limit: int = 25) -> DataFrame:
    """The first names of one installed version: its partition is read, and a top-k kept in every task."""
    return rows.where(version).orderBy(*order).limit(limit)


def chosen_language(current: DataFrame, installed: DataFrame, order: str) -> DataFrame:
    """(reader, lang): each reader's language if it is installed, else the first installed one by ``order``, else null.

    ``current`` has (reader, lang), ``installed`` (lang, order); the fallback is one row.
    """
    have = installed.where("lang is not null").groupBy("lang").agg(F.min(order).alias(order))
    first = have.agg(F.min_by("lang", F.struct(order, "lang")).alias("_first"))
    kept = current.select("reader", "lang").join(have.select("lang", F.lit(True).alias("_here")), "lang", "left")
    return kept.crossJoin(F.broadcast(first)).select("reader", F.when(F.col("_here"), F.col("lang")).otherwise(F.col("_first")).alias("lang"))


def merged_config(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left, right): two tables of settings, each with one row a key, as structs of a full outer join."""
    side = lambda df, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    return side(left, "left").join(side(right, "right"), key, "full_outer")


def installed_entries(versions: DataFrame) -> DataFrame:
    """(languages, entries) over installed versions (lang, entry_count); an unknown count is 0, no version gives 0."""
    return versions.agg(F.count("*").alias("languages"), F.coalesce(F.sum(F.coalesce("entry_count", F.lit(0))), F.lit(0)).cast("long").alias("entries"))
