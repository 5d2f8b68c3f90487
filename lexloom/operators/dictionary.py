"""Entry records to dictionary records: columns over the nested entry schema of ``sources.jsonl``.

Everything stays nested and inside the JVM; arrays keep their order and the first of equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.operators.forms import gender

# Parts of speech, labels and genders that records are held against.
INCLUDED_POS = (
    "noun", "verb", "adj", "adv", "prep", "conj", "pron", "det", "intj", "num", "particle", "affix", "prefix",
    "suffix", "phrase", "name", "article", "contraction", "postp", "ambiposition", "circumpos", "infix",
    "interfix", "circumfix", "combining_form", "root", "proverb", "prep_phrase", "adv_phrase", "classifier",
    "counter", "preverb", "converb", "adj_noun", "adj_verb", "adnominal",
)
SENSE_TAGS = (
    "formal", "informal", "colloquial", "literary", "archaic", "dated", "rare", "vulgar", "slang",
    "figurative", "transitive", "intransitive", "obsolete", "nonstandard", "dialectal", "regional",
    "misspelling", "historical", "poetic", "humorous", "offensive", "derogatory", "Early", "Old-Latin",
    "Classical-Latin", "Late-Latin", "Medieval-Latin", "New-Latin", "Ecclesiastical-Latin", "reflexive",
    "impersonal", "ditransitive", "countable", "uncountable", "usually-plural", "plural-only",
    "singular-only", "figuratively", "plural-normally", "ambitransitive", "familiar", "invariable",
    "emphatic", "intensifier", "idiomatic",
)
GENDER_TAGS = {"masculine": "m", "feminine": "f", "neuter": "n", "common-gender": "c"}
VALID_GENDERS = ("m", "f", "n", "c", "m-f", "mf", "m-p", "f-p", "n-p")
INHERITANCE = ("inh", "inherited", "bor", "borrowed", "der", "derived")


def category_names(categories: Column) -> Column:
    """Names of categories that are strings or objects with a name."""
    return F.transform(categories, lambda c: F.coalesce(F.get_json_object(c, "$.name"), c))


def is_valid(trusted_persian: Column | None = None) -> Column:
    """Whether an entry is a headword: part of speech, spelling and no category of its language that bars it.

    Entries of ``trusted_persian`` keep their place though their category says nonstandard script.
    """
    script = F.col("lang_code").isin("zh", "ja") & (F.col("pos") == "character")
    stem = (F.col("lang_code") == "nv") & (F.col("pos") == "stem")
    barred = F.array(F.concat("lang", F.lit(" multiword forms")), F.concat("lang", F.lit(" terms in nonstandard scripts")))
    native_latin = (F.col("lang") == "Navajo") & F.col("word").rlike(r"^[\P{L}\p{IsLatin}ʼ]*$")
    names = F.coalesce(category_names(F.col("categories")), F.array().cast("array<string>"))
    names = F.when(native_latin, F.array_remove(names, "Navajo terms in nonstandard scripts")).otherwise(names)
    if trusted_persian is not None:
        names = F.when(trusted_persian, F.array_remove(names, "Persian terms in nonstandard scripts")).otherwise(names)
    return (F.col("pos").isin(*INCLUDED_POS) | script | stem) & (F.col("word") != "") & ~F.arrays_overlap(names, barred)


def gloss_path(glosses: Column) -> Column:
    """The nesting path as one text, ': ' between parts unless a colon ends the one before; null if a part is unclean."""
    clean = F.transform(glosses, lambda g: t.clean_text(g))
    joined = F.aggregate(
        clean,
        F.lit("").cast("string"),
        lambda a, g: F.when(a == "", g).when(a.endswith(":"), F.concat(a, F.lit(" "), g)).otherwise(F.concat(a, F.lit(": "), g)),
    )
    return F.when((F.size(glosses) > 0) & F.forall(clean, lambda g: g.isNotNull()), joined)


def senses(column: Column) -> Column:
    """array of (gloss, tags, topics, qualifier) of the senses with a clean gloss."""

    def topics(s: Column) -> Column:
        raw = s["raw_glosses"]
        labels = F.array_join(F.filter(F.transform(raw, lambda r: F.regexp_extract(r, r"^\(([^)]+)\)", 1)), lambda x: x != ""), " ")
        named = lambda x: F.concat(F.lit(" "), F.regexp_replace(labels, r"[^\p{L}\p{M}\p{N}_]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.replace(x, F.lit("-"), F.lit(" ")), F.lit(" ")))
        kept = F.filter(s["topics"], lambda x: t.clean_text(x).isNotNull() & ((F.coalesce(F.size(raw), F.lit(0)) <= 0) | named(x)))
        return F.array_distinct(kept)

    made = F.transform(
        column,
        lambda s: F.struct(
            gloss_path(s["glosses"]).alias("gloss"),
            F.filter(s["tags"], lambda x: x.isin(*SENSE_TAGS)).alias("tags"),
            topics(s).alias("topics"),
            t.clean_text(s["qualifier"]).alias("qualifier"),
        ),
    )
    return F.filter(made, lambda s: s["gloss"].isNotNull())


def entry_gender() -> Column:
    """Gender of nouns and names: from sense tags in the order m, f, n, c, else from head templates."""
    tags = F.flatten(F.transform("senses", lambda s: F.coalesce(s["tags"], F.array().cast("array<string>"))))
    names = F.create_map(*[F.lit(x) for pair in GENDER_TAGS.items() for x in pair])
    found = gender(F.transform(F.filter(tags, lambda x: x.isin(*GENDER_TAGS)), lambda x: names[x]))
    heads = F.filter("head_templates", lambda h: h["args"]["g"].isin(*VALID_GENDERS))
    first = F.get(heads, 0)["args"]
    shown = F.when(first["g2"].isin(*VALID_GENDERS), F.concat_ws("-", first["g"], first["g2"])).otherwise(first["g"])
    return F.when(F.col("pos").isin("noun", "name"), F.coalesce(found, shown))


def pronunciation() -> Column:
    """The first clean IPA."""
    return F.get(F.filter(F.transform("sounds", lambda s: t.clean_text(F.get_json_object(s, "$.ipa"))), lambda x: x.isNotNull()), 0)


def etymology() -> Column:
    """The explanation without its tree, else the first clean expansion of an inheritance template."""
    end = F.concat(F.lit("\n"), F.col("lang"), F.lit(" "), F.col("word"), F.lit("\n"))
    raw = F.col("etymology_text")
    cut = F.when(raw.startswith("Etymology tree\n") & raw.contains(end), F.substring(raw, F.instr(raw, end) + F.length(end), F.length(raw))).otherwise(raw)
    templates = F.filter("etymology_templates", lambda e: e["name"].isin(*INHERITANCE) & t.clean_text(e["expansion"]).isNotNull())
    return F.coalesce(t.clean_text(cut), t.clean_text(F.get(templates, 0)["expansion"]))


def summary_gloss(column: Column) -> Column:
    """Up to three distinct short glosses, with '; ...' if there are more.

    Senses that refer to another form are left out, and so are later senses under a header that
    was seen; notes in brackets go.
    """
    empty = F.array().cast("array<string>")
    own = F.filter(column, lambda s: (F.coalesce(F.size(s["form_of"]), F.lit(0)) <= 0) & (F.coalesce(F.size(s["alt_of"]), F.lit(0)) <= 0) & (F.size(s["glosses"]) > 0))
    headed = F.transform(own, lambda s: F.struct(F.when(F.size(s["glosses"]) > 1, F.get(s["glosses"], 0)).otherwise(F.lit("")).alias("h"), F.element_at(s["glosses"], -1).alias("g")))
    start = F.struct(empty.alias("seen"), empty.alias("kept"))

    def step(a: Column, s: Column) -> Column:
        skip = F.array_contains(a["seen"], s["h"])
        seen = F.when(skip | (s["h"] == ""), a["seen"]).otherwise(F.array_append(a["seen"], s["h"]))
        return F.struct(seen.alias("seen"), F.when(skip | (s["g"] == ""), a["kept"]).otherwise(F.array_append(a["kept"], s["g"])).alias("kept"))

    lowered = F.transform(F.aggregate(headed, start, step, lambda a: a["kept"]), lambda g: F.concat(F.lower(F.substring(g, 1, 1)), F.substring(g, F.lit(2), F.length(g))))
    bare = F.transform(F.filter(lowered, lambda g: ~t.is_junk_gloss(g)), lambda g: F.trim(F.regexp_replace(F.regexp_replace(g, r"\s*\(.*?\)", ""), r"\s*\[.*?\]", "")))
    parts = F.flatten(F.transform(bare, lambda g: F.transform(F.split(g, ";"), lambda p: F.rtrim(F.trim(p), F.lit(".")))))
    parts = F.filter(parts, lambda p: (p != "") & ~t.is_junk_gloss(p))
    return F.when(F.size(parts) > 0, t.first_parts(parts, 3))


def relations(column: Column, word: Column) -> Column:
    """Distinct (word, sense, tags) of related words, the entry's own word left out."""

    def parsed(v: Column) -> Column:
        of = F.from_json(v, "word string, sense string, tags array<string>, raw_tags array<string>")
        tags = F.concat(F.coalesce(of["tags"], F.array().cast("array<string>")), F.coalesce(of["raw_tags"], F.array().cast("array<string>")))
        kept = F.filter(tags, lambda x: t.clean_text(x).isNotNull() & ~x.startswith("error-") & ~x.isin("synonym", "synonym-of"))
        name = t.clean_text(F.split_part(of["word"], F.lit("#"), F.lit(1)))
        good = ~name.rlike(r"[:/<>\[\]{},()]") & ~name.startswith("*") & ~name.isin("-", "?") & (F.length(name) <= 200) & (name != word)
        return F.struct(F.when(good, name).alias("word"), t.clean_text(of["sense"]).alias("sense"), F.array_distinct(kept).alias("tags"))

    return F.array_distinct(F.filter(F.transform(column, parsed), lambda r: r["word"].isNotNull()))


def distinct_forms() -> Column:
    """Clean spellings in the order in which they are first seen; table headers and class tags left out."""
    skipped = F.array(*map(F.lit, ("table-tags", "inflection-template", "class", "romanization", "transliteration", "classifier", "auxiliary")))
    kept = F.filter("forms", lambda f: ~F.coalesce(F.arrays_overlap(f["tags"], skipped), F.lit(False)))
    return F.array_distinct(F.filter(F.transform(kept, lambda f: t.clean_text(f["form"])), lambda x: x.isNotNull() & ~x.isin("-", "—", "–", "?")))


def records(entries: DataFrame) -> DataFrame:
    """One dictionary record per valid entry with a sense."""
    rows = entries.where(is_valid()).withColumn("_gender", entry_gender()).select(
        "src_ord",
        "lang_code",
        "word",
        "pos",
        senses(F.col("senses")).alias("senses"),
        summary_gloss(F.col("senses")).alias("gloss"),
        F.col("_gender").alias("gender"),
        distinct_forms().alias("forms"),
        pronunciation().alias("pronunciation"),
        etymology().alias("etymology"),
        relations(F.col("synonyms"), F.col("word")).alias("synonyms"),
        relations(F.col("antonyms"), F.col("word")).alias("antonyms"),
    )
    return rows.where(F.size("senses") > 0)
