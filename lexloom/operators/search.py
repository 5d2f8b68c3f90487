"""Batch search: stages with precedence, cascades, prefix fallback and ranking.

A query batch is a table. Each stage meets the index by an equi-join on the word, on its
first characters or on a trigram, so neither the vocabulary nor the batch is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.operators.index import trigrams
from lexloom.sources.versions import Table

LIMIT = 50


def _first(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("r") <= limit).drop("r")


def prefix_matches(entries: DataFrame, queries: DataFrame, word: str) -> DataFrame:
    """(q, entry columns) of entries whose word starts with the query's key."""
    heads = F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length(word))), lambda i: F.substring(F.col(word), F.lit(1), i))
    left = entries.where(F.length(word) > 0).select("*", F.explode(heads).alias("head"))
    right = queries.where(F.length("key") > 0).select("q", "key", F.substring("key", 1, 3).alias("head"))
    return left.join(right, "head").where(F.col(word).startswith(F.col("key"))).drop("head")


def substring_matches(entries: DataFrame, queries: DataFrame, word: str) -> DataFrame:
    """(q, entry columns) of entries that hold the query's key, of three characters or more."""
    left = entries.where(F.length(word) >= 3).select("*", F.explode(trigrams(F.col(word))).alias("gram"))
    right = queries.where(F.length("key") >= 3).select("q", "key", F.substring("key", 1, 3).alias("gram"))
    return left.join(right, "gram").where(F.col(word).contains(F.col("key"))).drop("gram")


def staged_search(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, w, lang, freq, gid, quality, stage) of every match, one row per (q, w, lang).

    Stages: 1 exact word, 2 exact folded form, 4 folded prefix (50), 6 substring (50, where
    stage 4 gave fewer than five). Stages 2 and 6 only add words that no earlier stage has;
    stage 4 replaces by better quality. ``first_stage`` is the stage that saw the word first.
    """
    words = entries.select("w", "lang", "freq", "gid", t.strip_diacritics(F.col("w")).alias("f"))
    keyed = queries.select("q", t.strip_diacritics(F.lower("q")).alias("key"))
    exact = words.join(queries.withColumn("w", F.col("q")), "w")
    form = words.join(keyed.withColumnRenamed("key", "f"), "f")
    return _staged(exact, form, prefix_matches(words, keyed, "f"), lambda few: substring_matches(words, few, "f"), keyed)


def indexed_search(tables: dict[str, Table], queries: DataFrame) -> DataFrame:
    """``staged_search`` over the published tables of ``index_tables``."""
    keyed = queries.select("q", t.strip_diacritics(F.lower("q")).alias("key"))
    exact = tables["words"].lookup(queries.select("q", F.col("q").alias("key")), "key")
    form = tables["forms"].lookup(keyed, "key")
    begun = keyed.where("key <> ''").select("q", "key", F.substring("key", 1, 3).alias("head"))
    prefix = tables["heads"].lookup(begun, "head").where(F.col("f").startswith(F.col("key")))

    def part(few: DataFrame) -> DataFrame:
        asked = few.where(F.length("key") >= 3).select("q", "key", F.substring("key", 1, 3).alias("gram"))
        return tables["trigrams"].lookup(asked, "gram").where(F.col("f").contains(F.col("key")))

    return _staged(exact, form, prefix, part, keyed)


def _staged(exact: DataFrame, form: DataFrame, prefix: DataFrame, part: Callable[[DataFrame], DataFrame], keyed: DataFrame) -> DataFrame:
    of = ("q", "w", "lang", "freq", "gid")
    exact = exact.select(*of, F.lit(1).alias("stage"), F.lit(0).alias("quality"))
    form = form.select(*of, F.lit(2).alias("stage"), F.lit(5).alias("quality"))
    prefix = _first(prefix, LIMIT, "gid")
    hits = prefix.groupBy("q").agg(F.count("*").alias("hits"))
    prefix = prefix.select(*of, F.lit(4).alias("stage"), F.when(F.col("w") == F.col("q"), 0).otherwise(10).alias("quality"))
    few = keyed.join(hits, "q", "left").where(F.coalesce("hits", F.lit(0)) < 5).drop("hits")
    found = _first(part(few), LIMIT, "gid").select(*of, F.lit(6).alias("stage"), F.lit(50).alias("quality"))
    rows = exact.unionByName(form).unionByName(prefix).unionByName(found)
    key = W.partitionBy("q", "w", "lang")
    rows = rows.withColumn("first_stage", F.min("stage").over(key)).where("stage not in (2, 6) or stage = first_stage")
    best = F.row_number().over(key.orderBy("quality", "stage"))
    return rows.withColumn("b", best).where("b = 1").select(*of, "quality", "first_stage")


def rank_matches(matches: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best ``limit`` words of each query: one row per word, then quality, capitals last, frequency, length."""
    word = W.partitionBy("q", "w").orderBy("quality", F.desc("freq"), "first_stage", "gid")
    one = matches.withColumn("b", F.row_number().over(word)).where("b = 1").drop("b")
    upper = F.col("w").rlike(r"^\p{Lu}").cast("int")
    order = W.partitionBy("q").orderBy("quality", upper, F.desc("freq"), F.length("w"), "first_stage", "gid")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def cascade(tiers: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first tier that has any for the key, in one plan."""
    rows = None
    for i, tier in enumerate(tiers, 1):
        tier = tier.withColumn("tier", F.lit(i))
        rows = tier if rows is None else rows.unionByName(tier)
    return rows.withColumn("_best", F.min("tier").over(W.partitionBy(key))).where("tier = _best").drop("_best")


def longest_prefix(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, prefix, ids) of the longest prefix of each query that the index has."""
    tries = queries.select("q", F.explode(F.transform(F.sequence(F.lit(1), F.length("q")), lambda i: F.substring(F.col("q"), F.lit(1), i))).alias("prefix"))
    found = tries.join(index, "prefix").groupBy("q").agg(F.max_by(F.struct("prefix", "ids"), F.length("prefix")).alias("x"))
    return found.select("q", "x.prefix", "x.ids")


def bucket_union(index: DataFrame, queries: DataFrame, cap: int = 200) -> DataFrame:
    """(q, id, place): ids of all words' buckets, smallest bucket first, distinct, capped."""
    words = queries.select("q", F.posexplode("words").alias("pos", "prefix"))
    hits = words.join(index, "prefix").select("q", "pos", F.size("ids").alias("n"), F.posexplode("ids").alias("at", "id"))
    least = hits.groupBy("q", "id").agg(F.min(F.struct("n", "pos", "at")).alias("o"))
    place = F.row_number().over(W.partitionBy("q").orderBy("o"))
    return least.withColumn("place", place).where(F.col("place") <= cap).select("q", "id", "place")
