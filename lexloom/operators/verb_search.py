"""Batch search over conjugated verbs: best quality per distinct spelling, and the order of languages.

Verbs have verb, lang, name, freq and cells (an array of cell texts, null ones skipped); queries have q
and lang, lower-cased as typed. A query meets spellings by its first characters, three of them or all it
has, as an equi-join on the spellings' runs of that length; nothing is compared with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as t

# Languages whose cells list whole spellings, final auxiliaries, and native names in Latin letters.
EXPANDED = ("pt", "ca", "nl", "sv", "fi", "la")
AUXILIARIES = ("haben", "sein")
TRANSLITERATED = {
    "ar": "arabiyya", "bn": "bangla", "hy": "hayeren", "ja": "nihongo", "pa": "punjabi", "ta": "tamil", "te": "telugu", "th": "thai", "ur": "urdu", "zh": "zhongwen",
    "el": "ellinika", "fa": "farsi", "he": "ivrit", "hi": "hindi", "ka": "kartuli", "ko": "hangugeo", "mk": "makedonski", "ru": "russkiy", "sa": "sanskritam", "uk": "ukrainska",
}


def spellings(name: Column, cells: Column, lang: Column) -> Column:
    """Distinct spellings of a verb: its name, and of each cell its variants or the word that a compound is about."""
    bare = lambda x: t.strip_markers(F.regexp_replace(x, r"\s+\([^()]+\)(?=[\]}]*$)", ""))
    last = lambda ws: F.when((F.size(ws) >= 3) & F.element_at(ws, -1).isin(*AUXILIARIES), F.element_at(ws, -2)).otherwise(F.element_at(ws, -1))
    reduced = lambda c: F.when(lang.isin(*EXPANDED), F.transform(F.split(c, "/"), bare)).otherwise(F.array(last(F.split(c, " "))))
    filled = F.filter(F.coalesce(cells, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != "")
    return F.array_distinct(F.concat(F.array(name), F.flatten(F.transform(filled, reduced))))


def _runs(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def native_matches(verbs: DataFrame, queries: DataFrame, whole_word: bool = False) -> DataFrame:
    """(q, lang, verb, root, matched, quality, freq): spellings that hold the query.

    Quality 0: as typed; 1: without marks; 2: in the language's sounds. With ``whole_word`` no letter may
    stand before or after the query. Queries that are null or empty match nothing.
    """
    form = F.explode(spellings(F.col("name"), F.col("cells"), F.col("lang")))
    rows = verbs.select("verb", "lang", F.col("name").alias("root"), "freq", form.alias("matched")).where("matched is not null")
    plain = F.lower(t.strip_diacritics(F.col("matched")))
    rows = rows.withColumn("low", F.lower("matched")).withColumn("plain", plain).withColumn("sound", t.phonetic(F.col("plain"), F.col("lang")))
    asked = queries.where("q <> ''").select("q", "lang").distinct()
    asked = asked.withColumn("q_plain", t.strip_diacritics(F.col("q"))).withColumn("q_sound", t.phonetic(F.col("q"), F.col("lang")))
    keys = F.array(*[F.substring(c, 1, 3) for c in ("q", "q_plain", "q_sound")])
    wanted = asked.select("*", F.explode(F.array_distinct(F.filter(keys, lambda g: g != ""))).alias("gram"))
    lengths = [r["n"] for r in wanted.select(F.length("gram").alias("n")).distinct().collect()]  # of 1, 2 and 3
    texts = ("low", "plain", "sound")
    grams = F.array_distinct(F.flatten(F.array(*[_runs(F.col(c), n) for n in lengths or [3] for c in texts])))
    met = rows.select("*", F.explode(grams).alias("gram")).join(wanted, ["lang", "gram"])

    def holds(text: str, query: str) -> Column:
        if not whole_word:
            return F.col(text).contains(F.col(query))
        return F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.col(query), F.lit(" ")))

    quality = F.when(holds("low", "q"), 0).when(holds("plain", "q_plain"), 1).when(holds("sound", "q_sound"), 2)
    found = met.withColumn("quality", quality).where("quality is not null")
    return found.select("q", "lang", "verb", "root", "matched", "quality", "freq").distinct()


def ranked_matches(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches with ``rank``: the very spelling first in expanded languages, then quality, frequency and length."""
    form = F.lower("matched")
    surface = F.when(form == F.col("q"), 0).when(t.strip_diacritics(form) == t.strip_diacritics(F.col("q")), 1).otherwise(2)
    order = [F.when(F.col("lang").isin(*EXPANDED), surface).otherwise(0), F.col("quality"), F.desc("freq"), F.length("matched"), F.col("verb"), F.col("matched")]
    rows = found.withColumn("rank", F.row_number().over(W.partitionBy("q", "lang").orderBy(*order)))
    return rows.where(F.col("rank") <= limit) if limit else rows


def language_order(languages: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """Languages with ``place``: by their names in Latin letters, without regard to case and marks, then by code.

    A table of languages is configuration, so one task numbers it.
    """
    latin = F.col(name)
    for known, shown in TRANSLITERATED.items():
        latin = F.when(F.col(code) == known, shown).otherwise(latin)
    order = [F.collate(latin, "UNICODE_CI_AI"), F.collate(F.col(code), "UNICODE_CI_AI")]
    return languages.withColumn("place", F.row_number().over(W.orderBy(*order)))
