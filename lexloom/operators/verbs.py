"""Verb entries for conjugation: clean roots, the form filters of each language and verb ids.

All are Columns over the nested entry schema of ``sources.jsonl``. Null arrays count as empty, and
a null word or form is never clean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.operators.dictionary import category_names
from lexloom.operators.forms import first_tables
from lexloom.plans.lexicon import dense_ids

# Tags, texts and patterns that bar a form, and heads that vouch for an entry.
BARRED_TEXTS = (
    "-",
    "Formed using present",
    "dependent (for simple past)",
    "present perfect from above with a particle (να, ας).",
    "no-table-tags",
)
BARRED_TAGS = ("table-tags", "inflection-template", "combined-form", "negative")
METADATA_TAGS = ("table-tags", "inflection-template", "class", "romanization", "error-unrecognized-form")
DASHES = ("-", "—", "–")
UNCLEAN = r"\{\{|\}\}|\[\[|\]\]|[<>+=\d]|Template:|Module:|\x{fffd}"
SOUND_SIGNS = "[\u0250-\u036f]"
SWEDISH_TAGS = ("infinitive", "indicative", "imperative", "subjunctive", "participle", "supine")
SWEDISH_HEADS = ("sv-verb-reg", "sv-verb-irreg")
HEAD_VOUCHES = ("la", "fi", "sv")
PERSIAN_HEADS = (
    "fa-verb",
    "fa-noun",
    "fa-adj",
    "fa-adv",
    "fa-proper noun",
    "fa-pron",
    "fa-num",
    "fa-prep",
    "fa-conj",
    "fa-intj",
    "fa-phrase",
)
ASPIRATED = "French terms with aspirated h"
ROMANCE_LABELS = r" \((?:Brazil|Portugal|pre-reform|figurative|cooking|stinging)(?:, (?:Brazil|Portugal|pre-reform|figurative|cooking|stinging))*\)$"
CATALAN_AUXILIARIES = ("vaig", "vas", "vares", "va", "vam", "vàrem", "vau", "vàreu", "van", "varen")


def _has(array: Column, *values: str) -> Column:
    return F.coalesce(F.arrays_overlap(array, F.array(*map(F.lit, values))), F.lit(False))


def _or_empty(array: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(array, F.array().cast(kind))


def _some(array: Column, test: Callable) -> Column:
    return F.coalesce(F.exists(array, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def _every(array: Column, test: Callable) -> Column:
    """Whether the array has members and all pass."""
    return (F.coalesce(F.size(array), F.lit(0)) > 0) & ~_some(array, lambda x: ~F.coalesce(test(x), F.lit(False)))


def is_verb_root() -> Column:
    """Whether an entry is a verb's own headword, not one of its forms, a phrase or a part of a word."""
    in_lang = F.col("lang_code")
    head = _some(F.col("head_templates"), lambda h: h["name"] == F.concat(in_lang, F.lit("-verb")))
    swedish = _some(
        F.col("head_templates"),
        lambda h: h["name"].isin(*SWEDISH_HEADS) | ((h["name"] == "head") & (h["args"]["1"] == "sv") & h["args"]["2"].isin("verb", "verbs")),
    )
    vouched = in_lang.isin(*HEAD_VOUCHES) & (head | ((in_lang == "sv") & swedish))
    kinds = ("multiword forms", "multiword terms", "idioms", "terms in nonstandard scripts")
    barred = F.array(*[F.concat_ws(" ", "lang", F.lit(k)) for k in kinds], F.when(~vouched, F.concat_ws(" ", "lang", F.lit("verb forms"))))
    barred = F.filter(barred, lambda x: x.isNotNull())
    held = lambda categories: F.coalesce(F.arrays_overlap(category_names(categories), barred), F.lit(False))
    return F.coalesce(
        (F.col("pos") == "verb")
        & ~F.col("word").rlike("['-]")
        & ~_every(F.col("senses"), lambda s: _has(s["tags"], "form-of", "alt-of"))
        & ~((in_lang == "el") & _some(F.col("head_templates"), lambda h: h["name"] == "el-part"))
        & ~_some(F.col("etymology_templates"), lambda e: e["name"].isin("participle of", "abbrev"))
        & ~held(F.col("categories"))
        & ~_every(F.col("senses"), lambda s: held(s["categories"])),
        F.lit(False),
    )


def is_aspirated() -> Column:
    """Whether the entry or one of its senses is of the words with an aspirated h."""
    of = lambda c: F.coalesce(F.array_contains(category_names(c), ASPIRATED), F.lit(False))
    return of(F.col("categories")) | _some(F.col("senses"), lambda s: of(s["categories"]))


def in_script(c: Column, script: str) -> Column:
    """Whether the text has letters and all are of the script."""
    return c.rlike(r"\p{L}") & ~c.rlike(rf"[\p{{L}}&&[^\p{{Is{script}}}]]")


def is_trusted_persian() -> Column:
    """A Persian word in Arabic script with a known head and a sense of its own."""
    own = _some(F.col("senses"), lambda s: (F.size(_or_empty(s["glosses"])) > 0) & ~_has(s["tags"], "form-of", "alt-of"))
    return F.coalesce((F.col("lang_code") == "fa") & in_script(F.col("word"), "Arabic") & _some(F.col("head_templates"), lambda h: h["name"].isin(*PERSIAN_HEADS)) & own, F.lit(False))


def _conjugated(form: Column) -> Column:
    return (form["source"] == "conjugation") & (form["form"] != "")


def clean_form(form: Column) -> Column:
    """The common filter: one word, or a compound tense that is tagged so; no sound signs, notes or placeholders."""
    x = form["form"]
    spaced = x.contains(" ") & ~x.contains(" - ")
    compound = _has(form["tags"], "multiword-construction") & ~x.contains("+")
    # Sound signs are those of the code points as given: a precomposed letter has none.
    bad = x.isin(*BARRED_TEXTS) | _has(form["tags"], *BARRED_TAGS) | x.rlike("['{]") | (spaced & ~compound) | x.rlike(SOUND_SIGNS) | ((F.length(x) > 2) & x.startswith("/") & x.endswith("/"))
    return F.coalesce((form["source"] == "conjugation") & ~bad, F.lit(False))


def clean_extended(form: Column) -> Column:
    """Latin and Finnish: negatives, compounds and macrons stay; a gender in brackets may end the form."""
    x = F.trim(form["form"])
    bare = F.regexp_replace(x, r" \((?:masculine|feminine|neuter)\)$", "")
    good = (x != "") & ~x.isin(*DASHES) & ~x.rlike(UNCLEAN) & bare.rlike(r"^[\p{L}\p{Mn} '’‑-]*$")
    return F.coalesce(_conjugated(form) & ~_has(form["tags"], *METADATA_TAGS) & good, F.lit(False))


def _germanic(form: Column, x: Column, spaces: Column) -> Column:
    good = (spaces | ~x.contains(" ")) & (x == F.trim(x)) & x.rlike(r"\p{L}") & x.rlike(r"^[\p{L}\p{M} '’-]*$")
    return F.coalesce(_conjugated(form) & ~_has(form["tags"], *METADATA_TAGS, "negative", "combined-form") & good, F.lit(False))


def clean_dutch(form: Column) -> Column:
    """Single words, and separable verbs in main clauses."""
    return _germanic(form, form["form"], _has(form["tags"], "main-clause"))


def clean_swedish(form: Column) -> Column:
    """Tagged verb forms, particles and abbreviations that inflect after a colon included."""
    x = form["form"]
    short = ~x.contains(":") | x.rlike(r"^[A-Za-z]{2,6}:[a-zåäö]+$")
    return F.coalesce(_has(form["tags"], *SWEDISH_TAGS) & short & _germanic(form, F.replace(x, F.lit(":"), F.lit("")), F.lit(True)), F.lit(False))


def clean_romance(form: Column) -> Column:
    """Portuguese and Catalan: one word after the region labels; a periphrastic form has its auxiliary before it."""
    x = F.regexp_replace(form["form"], ROMANCE_LABELS, "")
    # A middle dot stands inside Catalan words; a letter may bear one mark, for texts that are not in NFC.
    word = r"(?=.*\p{L})(?:[\p{L}·]|\p{L}\p{M})+"
    single, pair = x.rlike(f"^{word}$"), x.rlike(rf"^[^ ]+ {word}$") & F.split_part(x, F.lit(" "), F.lit(1)).isin(*CATALAN_AUXILIARIES)
    good = F.when(_has(form["tags"], "periphrastic"), pair).otherwise(single)
    return F.coalesce(_conjugated(form) & ~_has(form["tags"], *METADATA_TAGS) & good, F.lit(False))


#: The filter of each language; others take the common one.
FILTERS = {"la": clean_extended, "fi": clean_extended, "nl": clean_dutch, "sv": clean_swedish, "pt": clean_romance, "ca": clean_romance}


def clean_forms(forms: Column, lang: Column) -> Column:
    """The forms that the language's filter keeps, in order."""

    def kept(f: Column) -> Column:
        test = clean_form(f)
        for code, rule in FILTERS.items():
            test = F.when(lang == code, rule(f)).otherwise(test)
        return test

    return F.filter(forms, kept)


def verb_forms(entries: DataFrame, tables: dict[str, int] | None = None) -> DataFrame:
    """(src_ord, lang_code, word, pos, form, tags): the clean forms of clean verb roots, one row each, ``pos`` their place.

    ``tables`` names the languages of which only the first tables count; a row tagged as table opens one.
    """
    roots = entries.where(is_verb_root())
    rows = roots.select("src_ord", "lang_code", "word", F.posexplode("forms").alias("pos", "f"))
    opens = _has(F.col("f.tags"), "table-tags")
    limited = None
    for code, n in (tables or {}).items():
        part = first_tables(rows.where(F.col("lang_code") == code), ["src_ord"], "pos", opens, n).drop("table_no")
        limited = part if limited is None else limited.unionByName(part)
    rest = rows.where(~F.col("lang_code").isin(*(tables or {"": 0})))
    kept = (rest if limited is None else rest.unionByName(limited)).where(F.size(clean_forms(F.array("f"), F.col("lang_code"))) > 0)
    return kept.select("src_ord", "lang_code", "word", "pos", "f.form", "f.tags")


def verb_ids(verbs: DataFrame, name: str = "word", lang: str = "lang_code", order: str = "src_ord") -> DataFrame:
    """Ids from 0 in each language by the name without marks, equal names by their place in the source."""
    place = F.format_string("%s\u0000%020d", t.strip_diacritics(F.col(name)), F.col(order))
    numbered = dense_ids(verbs.withColumn("_one", F.lit(0)).withColumn("_name", place), [lang], "_one", "_name")
    return numbered.drop("_one", "_name")
