"""Token and lexicon plans on ``documents``: the base of the index and search operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as t


def token_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, w, p): every token with its place, from 1."""
    return docs.select("doc_id", "lang", F.posexplode(t.tokens(F.col("text"))).alias("p", "w")).select(
        "doc_id", "lang", "w", (F.col("p") + 1).cast("long").alias("p")
    )


def token_totals(docs: DataFrame) -> DataFrame:
    """(lang, w, n); no place is kept, so tokens are summed per task before the shuffle."""
    return docs.select("lang", F.explode(t.tokens(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))


def dense_ids(df: DataFrame, within: list[str], freq: str, name: str, id_col: str = "id") -> DataFrame:
    """Ids from 0 within each group, by frequency downwards and then by name.

    No group is sorted as a whole: rows are numbered inside small blocks of equal frequency and
    equal first two characters, and a table of block sizes gives each block its offset.
    """
    block = [*within, freq, "_head"]
    rows = df.withColumn("_head", F.substring(name, 1, 2))
    sizes = rows.groupBy(*block).agg(F.count("*").alias("_size"))
    before = W.partitionBy(*within).orderBy(F.desc(freq), "_head").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*block, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_from"))
    numbered = rows.withColumn("_at", F.row_number().over(W.partitionBy(*block).orderBy(name)))
    return numbered.join(offsets, block).withColumn(id_col, (F.col("_from") + F.col("_at") - 1).cast("long")).select(*df.columns, id_col)


def lexicon(docs: DataFrame) -> DataFrame:
    """(lang, w, n, freq, id): words of each language with Zipf frequency and frequency rank."""
    counts = token_totals(docs)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(totals, "lang").select("lang", "w", "n", t.zipf(F.col("n"), F.col("total")).alias("freq"))
    return dense_ids(rated, ["lang"], "freq", "w")


def entries(docs: DataFrame) -> DataFrame:
    """The lexicon with one more id over all languages, the rank that search results follow."""
    lex = lexicon(docs).withColumn("name", F.concat_ws("|", "w", "lang")).withColumn("_all", F.lit(0))
    return dense_ids(lex, ["_all"], "freq", "name", "gid").select("lang", "w", "n", "freq", "id", "gid")


def query_words(benchmark: DataFrame) -> DataFrame:
    """(q): the distinct first tokens of the benchmark texts."""
    return benchmark.select(F.get(t.tokens(F.col("text")), 0).alias("q")).where("q is not null").distinct()


def ranked(order: list[Column], *within: str) -> Column:
    return F.row_number().over(W.partitionBy(*within).orderBy(*order))
