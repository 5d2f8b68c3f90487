"""Search in all stages over dictionary entries, for a table of queries.

Entries have id, lang, word, pos and freq, and may have forms, aliases, glosses and romanizations
(arrays of strings; absent columns and nulls count as empty). Queries have q and lang. No stage is a
cross join: every one meets the entries by an equi-join on a key, a token, a head or a trigram,
verifies what it found and, where a stage is limited, keeps the first by id: as many as ``most``, or all if it
is None. Where ids are not ranks of frequency, a limit by id loses words that the full rank would put first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import normal
from lexloom.functions import text as t
from lexloom.operators.index import trigrams

# The order of the stages, their qualities and limits.
EXACT, INFLECTED, ALIAS, WORD, FORMS, GLOSS, SOUND, SOUND_PREFIX, PART, ROMAN, ROMAN_PREFIX = range(1, 12)
QUALITY = {EXACT: 0, INFLECTED: 5, ALIAS: 5, WORD: 10, FORMS: 20, GLOSS: 40, SOUND: 5, SOUND_PREFIX: 30, PART: 50, ROMAN: 6, ROMAN_PREFIX: 40}
ADDS_ONLY = (INFLECTED, ALIAS, SOUND_PREFIX, PART)
LIMIT, FEW, NO_GLOSS = 50, 5, 9999
#: Queries that are broadcast; more of them meet the entries by a shuffle.
BROADCAST_QUERIES = 5_000

_NONE = "array<string>"


def _strings(entries: DataFrame, name: str) -> Column:
    empty = F.array().cast(_NONE)
    return F.coalesce(F.filter(name, lambda x: x.isNotNull()), empty) if name in entries.columns else empty


def _words(texts: Column) -> Column:
    """Distinct tokens of several texts, without marks."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda x: t.tokens(t.strip_diacritics(x)))))


def romanized(c: Column, lang: Column) -> Column:
    """The romanised key under the profile of the row's language; null where there is none."""
    key = F.lit(None).cast("string")
    for code in t.ROMANIZATION:
        key = F.when(lang == code, t.romanization_key(c, code)).otherwise(key)
    return key


def prepared(entries: DataFrame) -> DataFrame:
    """Entries with the keys and tokens of every stage; write it once and search it often.

    Keys and tokens are those of composed text, so spellings of equal letters meet; ``word`` stays as it is.
    """
    lang = F.col("lang")
    rows = entries.select(
        "id", "lang", "word", "pos", "freq",
        normal.nfc("word").alias("_word"),
        normal.searchable("word", "lang").alias("_alias"),
        *[normal.nfc_each(_strings(entries, name)).alias(name) for name in ("forms", "aliases", "glosses", "romanizations")],
    )
    forms, readings = F.concat("forms", "aliases"), F.col("romanizations")
    keys = F.transform(forms, lambda x: t.word_key(x, lang))
    sounds = F.when(lang == "el", F.transform(F.concat(F.array("_word"), "forms"), lambda x: t.greek_phonetic(x)))
    key, alias = t.word_key(F.col("_word"), lang), t.search_key(F.col("_alias"), lang)
    return rows.select(
        "id", "lang", "word", "pos", "freq",
        key.alias("key"),
        alias.alias("alias_key"),
        F.array_distinct(keys).alias("form_keys"),
        _words(F.array(key, alias)).alias("word_tokens"),
        _words(forms).alias("form_tokens"),
        _words(F.col("glosses")).alias("gloss_tokens"),
        F.transform("glosses", lambda x: F.lower(x)).alias("glosses"),
        F.get(sounds, 0).alias("sound"),
        _words(F.coalesce(sounds, F.array().cast(_NONE))).alias("sound_tokens"),
        F.concat_ws(" ", F.lower("_word"), F.concat_ws(" ", F.coalesce(sounds, F.array().cast(_NONE)))).alias("surface"),
        F.array_distinct(F.transform(readings, lambda x: F.lower(x))).alias("readings"),
        F.array_distinct(F.filter(F.transform(readings, lambda x: romanized(x, lang)), lambda x: x.isNotNull() & (x != ""))).alias("roman_keys"),
    )


def asked(queries: DataFrame) -> DataFrame:
    """Distinct queries with their keys and terms; those without a letter or number go."""
    q, lang = F.trim("_q"), F.col("lang")
    # A last term of one character among several is a word that is still being typed.
    typed = lambda c: F.when((F.size(c) > 1) & (F.length(F.element_at(c, -1)) < 2), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(1)))).otherwise(c)
    lookup = t.search_key(F.trim("_alias"), lang)
    sound = F.when(lang == "el", t.greek_phonetic(q))
    return (
        queries.select("q", "lang").where("q is not null and lang is not null").distinct()
        .withColumn("_q", normal.nfc("q"))
        .withColumn("_alias", normal.searchable("q", "lang"))
        .withColumn("key", t.word_key(q, lang))
        .withColumn("lookup", lookup)
        .withColumn("low", F.lower(q))
        .withColumn("spoken", t.tokens(lookup))
        .where(F.size("spoken") > 0)
        .withColumn("terms", typed(t.tokens(t.strip_diacritics(lookup))))
        .withColumn("gloss_terms", typed(t.tokens(t.strip_diacritics(F.lower(q)))))
        .withColumn("sound", sound)
        .withColumn("sound_terms", t.tokens(sound))
        .withColumn("roman_key", romanized(q, lang))
        .withColumn("latin", t.is_latin(t.word_key(q, lang)))
        .drop("_q", "_alias")
    )


def _equal(entries: DataFrame, queries: DataFrame, key: Column, to: str) -> DataFrame:
    left = entries.select("id", "lang", "freq", key.alias("k")).where("k is not null")
    return left.join(queries.where(F.col(to).isNotNull()).select("q", "lang", F.col(to).alias("k")), ["lang", "k"]).select("q", "lang", "id", "freq")


def _all_terms(entries: DataFrame, queries: DataFrame, field: str, terms: str, prefix: bool = True) -> DataFrame:
    """(q, lang, id): the field has every term, the last as the start of a token if ``prefix``.

    The rarest guess of a term, the longest whole one, finds the entries; the others verify them.
    """
    size = F.size("terms")
    body = F.when(size > 1, F.slice("terms", 1, F.greatest(size - 1, F.lit(1)))).otherwise(F.array().cast(_NONE)) if prefix else F.col("terms")
    longest = F.element_at(F.array_sort(F.transform("body", lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"]
    right = (
        queries.select("q", "lang", F.col(terms).alias("terms")).where(F.size("terms") > 0)
        .withColumn("body", body)
        .withColumn("last", F.element_at("terms", -1))
        .withColumn("gram", F.when(F.size("body") > 0, F.concat(F.lit("="), longest)).otherwise(F.concat(F.lit("^"), F.substring("last", 1, 3))))
    )
    heads = lambda x: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length(x))), lambda i: F.concat(F.lit("^"), F.substring(x, F.lit(1), i)))
    grams = F.transform(field, lambda x: F.concat(F.lit("="), x))
    grams = F.concat(grams, F.flatten(F.transform(field, heads))) if prefix else grams
    left = entries.select("id", "lang", F.col(field).alias("has"), F.explode(F.array_distinct(grams)).alias("gram"))
    held = F.forall("body", lambda x: F.array_contains(F.col("has"), x))
    held = held & F.exists("has", lambda x: x.startswith(F.col("last"))) if prefix else held
    return left.join(right, ["lang", "gram"]).where(held).select("q", "lang", "id")


def _parts(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, lang, id): every term of three characters or more stands somewhere in the surface."""
    usable = F.filter("spoken", lambda x: F.length(x) >= 3)
    right = queries.select("q", "lang", usable.alias("terms")).where(F.size("terms") > 0)
    right = right.withColumn("gram", F.substring(F.element_at(F.array_sort(F.transform("terms", lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"], 1, 3))
    left = entries.where(F.length("surface") >= 3).select("id", "lang", "surface", F.explode(trigrams(F.col("surface"))).alias("gram"))
    return left.join(right, ["lang", "gram"]).where(F.forall("terms", lambda x: F.col("surface").contains(x))).select("q", "lang", "id")


def _staged(rows: DataFrame, stage: int, quality: Column | None = None, order: Column | None = None, at: str | None = None) -> DataFrame:
    value = F.lit(QUALITY[stage]) if quality is None else quality
    place = F.lit(0.0) if order is None else order
    key = F.lit("") if at is None else F.col(at)
    return rows.select("q", "lang", "id", F.lit(stage).alias("stage"), value.cast("int").alias("quality"), place.cast("double").alias("place"), key.alias("at"))


def _first(rows: DataFrame, most: int | None, *order: str) -> DataFrame:
    if most is None:
        return rows
    window = W.partitionBy("q", "lang").orderBy(*(order or ("id",)))
    return rows.withColumn("r", F.row_number().over(window)).where(F.col("r") <= most).drop("r")


def stage_rows(entries: DataFrame, queries: DataFrame, side: str = "merge", most: int | None = LIMIT) -> DataFrame:
    """(q, lang, id, stage, quality, place, at) of every stage over prepared entries and asked queries.

    ``side`` is the hint of the queries, ``broadcast`` if they are few; entries are never broadcast.
    """
    entries, queries = entries.hint("merge"), queries.hint(side)
    form_keys = entries.select("id", "lang", "freq", F.explode("form_keys").alias("k"))
    in_word = _first(_all_terms(entries, queries, "word_tokens", "terms"), most)
    hits = in_word.groupBy("q", "lang").agg(F.count("*").alias("hits"))
    few = queries.join(hits, ["q", "lang"], "left").where((F.coalesce("hits", F.lit(0)) < FEW) & (F.length(F.concat_ws(" ", "spoken")) >= 3)).hint(side)
    sounding = _all_terms(entries, queries, "sound_tokens", "sound_terms", prefix=False)
    sounding = sounding.join(queries.select("q", "lang", "sound"), ["q", "lang"]).join(entries.select("id", "lang", F.col("sound").alias("of")), ["id", "lang"])
    said = _first(_all_terms(entries, queries, "sound_tokens", "sound_terms"), most).join(queries.select("q", "lang", "latin"), ["q", "lang"])
    roman = entries.select("id", "lang", "readings", F.explode("roman_keys").alias("k"))
    romans = queries.where("roman_key <> ''").select("q", "lang", "low", F.col("roman_key").alias("k"))
    original = F.when(F.array_contains("readings", F.col("low")), 5).otherwise(QUALITY[ROMAN])
    heads = roman.where(F.length("k") >= 2).select("id", "lang", "k", F.substring("k", 1, 2).alias("h"))
    starts = romans.where(F.length("k") >= 2).select("q", "lang", F.col("k").alias("to"), F.substring("k", 1, 2).alias("h"))
    began = _first(heads.join(starts, ["lang", "h"]).where(F.col("k").startswith(F.col("to"))), most, "k", "id")
    parts = [
        _staged(_equal(entries, queries, F.col("key"), "key"), EXACT),
        _staged(_equal(form_keys, queries, F.col("k"), "key"), INFLECTED, order=-F.col("freq")),
        _staged(_equal(entries, queries, F.col("alias_key"), "lookup"), ALIAS),
        _staged(in_word, WORD),
        _staged(_first(_all_terms(entries, queries, "form_tokens", "terms"), most), FORMS),
        _staged(_first(_all_terms(entries, queries, "gloss_tokens", "gloss_terms"), most), GLOSS),
        _staged(sounding.where("of = sound"), SOUND),
        _staged(said, SOUND_PREFIX, F.when(F.col("latin"), 40).otherwise(QUALITY[SOUND_PREFIX])),
        _staged(_first(_parts(entries, few), most), PART),
        _staged(roman.join(romans, ["lang", "k"]), ROMAN, original),
        _staged(began, ROMAN_PREFIX, at="k"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def matches(entries: DataFrame, queries: DataFrame, side: str = "merge", most: int | None = LIMIT) -> DataFrame:
    """One row per (q, lang, word, pos): the best quality, and the stage and place that saw it first.

    Inflections, aliases, sound prefixes and parts only add what no earlier stage has; the other
    stages replace by better quality. Each stage's rows of a key are one before the stages are compared.
    """
    # Written tables of repeated values are far smaller as files than as rows: without the hints they would be broadcast.
    shown = entries.hint("merge").select("id", "lang", "word", "pos", "freq", "key", "glosses")
    found = stage_rows(entries, queries, side, most).join(shown, ["id", "lang"])
    found = found.join(queries.hint(side).select("q", "lang", F.col("key").alias("asked_key"), "low"), ["q", "lang"])
    whole = (F.col("stage") == WORD) & (F.col("key") == F.col("asked_key"))
    found = found.withColumn("quality", F.when(whole, 0).otherwise(F.col("quality")))
    at = F.array_position(F.transform("glosses", lambda g: g.contains(F.col("low"))), True)
    found = found.withColumn("gloss_at", F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(NO_GLOSS))
    key = ["q", "lang", "word", "pos"]
    seen = F.struct("stage", "place", "at", "id")
    best = F.min(F.struct("quality", seen.alias("seen"), "id", "freq", "stage", "gloss_at"))
    staged = found.groupBy(*key, "stage").agg(best.alias("x"), F.min(seen).alias("seen"))
    staged = staged.withColumn("first_seen", F.min("seen").over(W.partitionBy(*key)))
    staged = staged.where(~F.col("stage").isin(*ADDS_ONLY) | (F.col("stage") == F.col("first_seen.stage")))
    out = staged.groupBy(*key).agg(F.min("x").alias("x"), F.min("first_seen").alias("first_seen"))
    return out.select(*key, "x.id", "x.freq", "x.quality", "x.stage", "x.gloss_at", "first_seen")


def ranked(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best words of each query: one row per word, then quality, gloss place, names and capitals last, frequency, length."""
    key = ["q", "lang", "word"]
    shown = F.min_by(F.struct("id", "pos", "freq", "quality", "stage", "gloss_at"), F.struct("quality", -F.col("freq"), "first_seen"))
    words = found.groupBy(*key).agg(shown.alias("x"), F.min("first_seen").alias("first_seen")).select(*key, "x.*", "first_seen")
    initial = F.substring("word", 1, 1)
    order = W.partitionBy("q", "lang").orderBy(
        "quality",
        F.when(F.col("quality") == QUALITY[GLOSS], F.col("gloss_at")).otherwise(0),
        F.coalesce(F.col("pos") == "name", F.lit(False)),
        initial != F.lower(initial),
        F.desc("freq"),
        F.length("word"),
        "first_seen",
    )
    return words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("first_seen")


def stored(rows: DataFrame, folder: str) -> DataFrame:
    """The rows as a table of the shared folder, so that no stage makes their keys again."""
    path = f"{folder}/search-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def search(entries: DataFrame, queries: DataFrame, folder: str, limit: int = LIMIT, most: int | None = LIMIT) -> DataFrame:
    """(q, lang, word, id, pos, freq, quality, stage, gloss_at, rank) of the best words for each query.

    ``most`` is the limit of each limited stage; with None every match of every stage is ranked.
    """
    # Keys cost far more than the bytes of their rows, so entries are spread before.
    tasks = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries.sparkSession.sparkContext.defaultParallelism)
    rows, terms = stored(prepared(entries.repartition(tasks)), folder), stored(asked(queries), folder)
    side = "broadcast" if terms.count() <= BROADCAST_QUERIES else "merge"
    return ranked(matches(rows, terms, side, most), limit)
