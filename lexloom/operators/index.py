"""Index tables: reverse forms, postings, prefixes and trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as t


def form_lookup(tokens: DataFrame) -> DataFrame:
    """(form_key, doc_id): distinct folded forms and where they stand."""
    return tokens.select(t.strip_diacritics(F.col("w")).alias("form_key"), "doc_id").distinct()


def prefixes(word: Column, low: int, high: int) -> Column:
    """Lower-cased prefixes of low to high characters; cut first, lowered then."""
    return F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(word))), lambda i: F.lower(F.substring(word, F.lit(1), i)))


def capped_postings(rows: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key; hot keys are cut in each task before the shuffle."""
    return rows.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= cap)


def prefix_index(lex: DataFrame, cap: int = 200, low: int = 1, high: int = 6) -> DataFrame:
    """(lang, prefix, ids): ids of words by prefix of the word or of its folded spelling, in order of rank."""
    long_enough = F.length("w") >= low
    both = lex.where(long_enough).select("lang", "id", F.explode(F.array_distinct(F.array(F.col("w"), t.strip_diacritics(F.col("w"))))).alias("w"))
    rows = both.where(long_enough).select("lang", "id", F.explode(prefixes(F.col("w"), low, high)).alias("prefix")).distinct()
    kept = capped_postings(rows, ["lang", "prefix"], [F.col("id")], cap)
    return kept.groupBy("lang", "prefix").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def gloss_words(text: Column) -> Column:
    """Distinct content words of a gloss: notes in brackets, short words and stop words left out."""
    clauses = F.filter(F.split(text, "; "), lambda c: (c != "...") & ~t.is_junk_gloss(c))
    words = F.flatten(F.transform(clauses, lambda c: F.split(F.lower(F.regexp_replace(c, r"\s*\[.*?\]", "")), r"[\s,;]+")))
    bare = F.transform(words, lambda w: F.btrim(w, F.lit("().[]'\"")))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(*t.GLOSS_STOP_WORDS)))


def gloss_prefix_index(rows: DataFrame, id_col: str, gloss: str, cap: int = 200) -> DataFrame:
    """(prefix, ids) over 3 to 6 characters of gloss words."""
    words = rows.select(F.col(id_col).alias("id"), F.explode(gloss_words(F.col(gloss))).alias("w"))
    pairs = words.select("id", F.explode(prefixes(F.col("w"), 3, 6)).alias("prefix")).distinct()
    kept = capped_postings(pairs, ["prefix"], [F.col("id")], cap)
    return kept.groupBy("prefix").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(c, i, F.lit(3))))


def index_tokens(cell: Column, expanded: bool = False) -> Column:
    """Index words of a conjugation cell: variants apart, notes and brackets off.

    Expanded languages index the phrase and its words; others its last word, or the one before
    a final German auxiliary.
    """
    variants = F.transform(F.split(cell, "/"), lambda s: t.strip_markers(F.regexp_replace(s, r"\s+\([^()]+\)(?=[\]}]*$)", "")))
    variants = F.filter(variants, lambda s: (F.trim(s) != "") & (s != "-"))
    if expanded:
        return F.array_distinct(F.flatten(F.transform(variants, lambda s: F.concat(F.array(s), F.split(F.trim(s), r"\s+")))))
    words = lambda s: F.split(s, " ")
    last = lambda s: F.when((F.size(words(s)) >= 3) & F.element_at(words(s), -1).isin("haben", "sein"), F.element_at(words(s), -2)).otherwise(F.element_at(words(s), -1))
    return F.array_distinct(F.transform(variants, last))
