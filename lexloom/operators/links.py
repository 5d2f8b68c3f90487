"""Links between entries: parsing, verification by semi-joins and language routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as t

# Namespaces that are no words, sections of entries, and names of templates by the layout of their arguments.
NAMESPACES = ("category", "file", "image", "appendix", "template", "module", "special", "thesaurus", "wikipedia", "w", "s")

SECTIONS = ("Noun", "Verb", "Adjective", "Adverb", "Pronoun", "Etymology")
BORROWING = (
    "inh", "inherited", "bor", "borrowed", "der", "derived", "lbor", "learned borrowing", "ubor", "unadapted borrowing",
    "slbor", "semi-learned borrowing", "uder",
)
MENTIONS = ("m", "mention", "l", "link", "cog", "cognate", "ncog", "noncog", "noncognate")
COMPOUNDS = ("af", "affix", "compound", "com", "surf", "surface analysis", "doublet", "dbt")


def link_target(target: Column, anchors: dict[str, str], own: Column) -> Column:
    """struct(word, lang, anchor) of 'word#anchor', or null for what is no word link."""
    word, anchor = F.trim(F.split_part(target, F.lit("#"), F.lit(1))), F.split_part(target, F.lit("#"), F.lit(2))
    lang = own
    for name, code in anchors.items():
        lang = F.when(anchor == name, F.lit(code)).otherwise(lang)
    bad = (word == "") | (F.length(word) > 200) | word.rlike(r"[{}\[\]<>|]") | F.lower(F.split_part(word, F.lit(":"), F.lit(1))).isin(*NAMESPACES) & word.contains(":")
    return F.when(~bad, F.struct(word.alias("word"), lang.alias("lang"), F.nullif(anchor, F.lit("")).alias("anchor")))


def word_link(target: Column, lang: Column, label: Column, anchors: dict[str, str]) -> Column:
    """struct(word, lang, anchor, label) of a template's word, or null for what is no headword.

    An anchor that names a language is that language; one that names neither a language nor a section
    of an entry leaves the language empty. A label is kept where it differs from the word.
    """
    clean = t.clean_text(target)
    word, anchor = F.regexp_extract(clean, r"(?s)^([^#]*)", 1), F.regexp_extract(clean, r"(?s)^[^#]*#(.*)$", 1)
    named = F.lit(None).cast("string")
    for name, code in anchors.items():
        named = F.when(F.replace(anchor, F.lit("_"), F.lit(" ")) == name, code).otherwise(named)
    whose = F.when(named.isNotNull(), named).when((anchor == "") | anchor.isin(*SECTIONS), lang).otherwise("")
    good = ~clean.isin("-", "?") & ~clean.startswith("*") & (word != "") & ~word.rlike(r"[:/<>\[\]{},()]") & (F.length(word) <= 200)
    shown = t.clean_text(label)
    made = F.struct(word.alias("word"), whose.alias("lang"), F.when(named.isNull(), F.nullif(anchor, F.lit(""))).alias("anchor"), F.when(shown != word, shown).alias("label"))
    return F.when(good, made)


def etymology_links(templates: Column, anchors: dict[str, str]) -> Column:
    """Distinct links of an entry's etymology templates, in order, from the places that each kind of template gives its words."""
    made = "array<struct<word:string,lang:string,label:string>>"

    def terms(e: Column) -> Column:
        args = F.coalesce(e["args"], F.create_map().cast("map<string,string>"))
        of = lambda key: F.nullif(F.try_element_at(args, F.lit(key) if isinstance(key, str) else key), F.lit(""))
        term = lambda lang, word, label: F.struct(word.alias("word"), lang.alias("lang"), label.alias("label"))
        name = F.regexp_replace(e["name"], r"\+$", "")
        # Other templates called by a surface analysis have arguments of their own.
        called = name.isin("surf", "surface analysis") & F.coalesce(of("1"), F.lit("")).startswith("+")
        places = F.transform(F.filter(F.map_keys(args), lambda k: k.rlike(r"^[1-9]\d{0,8}$")), lambda k: k.cast("int"))
        places = F.array_sort(F.filter(places, lambda p: p >= 2))
        key = lambda head, p: F.concat(F.lit(head), p.cast("string"))
        parts = F.transform(places, lambda p: term(F.coalesce(of(key("lang", p - 1)), of("1")), of(key("", p)), of(key("alt", p - 1))))
        return (
            F.when(called, F.array().cast(made))
            .when(name.isin(*BORROWING), F.array(term(of("2"), of("3"), F.coalesce(of("alt"), of("4")))))
            .when(name.isin(*MENTIONS), F.array(term(of("1"), of("2"), F.coalesce(of("alt"), of("3")))))
            .when(name.isin(*COMPOUNDS), parts)
            .otherwise(F.array().cast(made))
        )

    listed = F.filter(F.flatten(F.transform(templates, terms)), lambda x: x["lang"].isNotNull())
    links = F.transform(listed, lambda x: word_link(x["word"], x["lang"], x["label"], anchors))
    return F.coalesce(F.array_distinct(F.filter(links, lambda x: x.isNotNull())), F.array().cast("array<struct<word:string,lang:string,anchor:string,label:string>>"))


def exact_headwords(requested: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Requested words that are headwords, by exact spelling."""
    return requested.distinct().join(entries, keys, "left_semi")


def verified_links(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Links with ``verified``: whether (lang, word) is a headword; each pair is looked up once."""
    pairs = links.select("lang", "word").distinct().join(entries.select("lang", "word"), ["lang", "word"], "left_semi")
    return links.join(pairs.withColumn("verified", F.lit(True)), ["lang", "word"], "left").fillna(False, ["verified"])


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return rows.join(parents, key, "left_anti")


def route_languages(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(code, terminal): each code's last ancestor along parent links; a cycle ends at its first code again.

    The parent table is configuration of a few hundred rows.
    """
    edges.createOrReplaceTempView("lexloom_parents")
    return spark.sql(
        """WITH RECURSIVE walk(code, at, path, done) AS (
             SELECT code, code, array(code), false FROM lexloom_parents
             UNION ALL
             SELECT w.code, p.parent, array_append(w.path, p.parent), array_contains(w.path, p.parent)
             FROM walk w JOIN lexloom_parents p ON w.at = p.code
             WHERE NOT w.done AND p.parent IS NOT NULL)
           SELECT code, max_by(at, size(path)) AS terminal, max(size(path)) AS steps FROM walk GROUP BY code"""
    )


def merged_links(links: DataFrame, keys: list[str], order: str, tags: str) -> DataFrame:
    """Links of equal keys as one, at the first one's place, with the union of their tags."""
    gathered = F.array_sort(F.collect_list(F.struct(order, tags)))
    union = F.array_distinct(F.flatten(F.transform(gathered, lambda x: x[tags])))
    return links.groupBy(*keys).agg(F.min(order).alias(order), union.alias(tags))
