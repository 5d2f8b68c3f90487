"""What a dictionary record holds beside glosses: usage examples, references of senses, readings, redirects.

All are Column expressions inside the entry's row: no shuffle, and arrays keep the source's order.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.operators import dictionary, links, readings, verbs

# Requests for missing details, languages with readings, labels of readings, and limits.
REQUEST = "(?i)please (?:add|provide|specify)"
REQUEST_NOTE = r"\([^)]*(?i:please (?:add|provide|specify))[^)]*\)"
READING_LANGUAGES = ("ar", "zh", "ja", "ast", "nv", "sq", "te", "sw", "hy", "th", "ceb", "ta", "bn", "pa", "ur")
KANA = "^[ぁ-ゖァ-ヶー ・]+$"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
DASHES = ("-", "—", "–", "?")
EXAMPLE_LENGTH, EXAMPLES = 1200, 3
# Languages whose records are enhanced, those without gender, what is no example, and templates that state a gender by argument.
ENHANCED = (
    "grc", "az", "eu", "br", "et", "ka", "he", "hi", "is", "ga", "ko", "lt", "mk", "ms", "oc", "fa", "sa", "sh", "sk", "cy", "nn", "lv",
    "bg", "mt", "tl", "gd", "fo", "ang", "non", "ar", "zh", "ja", "ast", "nv", "sq", "te", "sw", "hy", "th", "ceb", "ta", "bn", "pa", "ur",
)
GENDERLESS = ("az", "eu", "et", "ka", "ko", "ms", "fa", "tl")
LINKAGE = "^(?:Near-synonyms?|Synonyms?|Antonyms?|Hypernyms?|Hyponyms?|Coordinate terms?):"
BROKEN_ENTITY = r"[A-Za-z]#\d+;|&#?\d+;.*#\d+;"
GENDER_ARGUMENTS = {"grc-noun": "3", "sa-noun": "1", "sh-noun": "2", "mk-noun": "1"}

SPACE = r"(?U)^[\s\x1c-\x1f]+"
_EXAMPLE = (
    "text string, type string, translation string, english string, roman string, ref string, "
    "bold_text_offsets array<string>, bold_translation_offsets array<string>"
)
_RANGES = "array<struct<start:int,stop:int>>"
_LINKS = "array<struct<word:string,lang:string,anchor:string,label:string>>"
_READINGS = "array<struct<text:string,label:string>>"


def _bound(value: Column, f) -> Column:
    """``f(value)``, with the value computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _left(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def _clean(c: Column) -> Column:
    """Clean text without the white space around it."""
    return _bound(F.regexp_replace(_left(c), r"(?U)[\s\x1c-\x1f]+\z", ""), t.clean_text)


def emphasis(text: Column, raw: Column, offsets: Column) -> Column:
    """Sorted ranges of code points of the trimmed text; offsets count in the raw text, and invalid pairs go.

    A pair is the JSON text of two integers.
    """
    pairs = F.filter(offsets, lambda p: p.rlike(r"^\[\s*\d{1,9}\s*,\s*\d{1,9}\s*\]$"))
    cut = F.length(raw) - F.length(_left(raw))
    at = lambda p, k: F.regexp_extract(p, r"(\d+)\s*,\s*(\d+)", k).cast("int")
    moved = F.transform(pairs, lambda p: F.struct((at(p, 1) - cut).alias("start"), (at(p, 2) - cut).alias("stop")))
    inside = F.filter(moved, lambda r: (r["start"] >= 0) & (r["start"] < r["stop"]) & (r["stop"] <= F.length(text)))
    return F.coalesce(F.array_sort(inside), _empty(_RANGES))


def usage_examples(values: Column) -> Column:
    """The first three distinct examples, usage before quotations, each in source order.

    ``values`` are JSON texts; what is no object, has no clean text, is longer than 1,200 code points
    or bears bold marks goes. Requests for details count as no detail. Null gives an empty array.
    """

    def shown(c: Column) -> Column:
        text = _clean(c)
        return F.when(~text.rlike(REQUEST), text)

    def made(v: Column) -> Column:
        raw_translation = F.coalesce(F.nullif(v["translation"], F.lit("")), v["english"])
        text, translation = _clean(v["text"]), shown(raw_translation)
        # The note goes before the check, so a reference that has more to say stays.
        ref = F.nullif(F.trim(F.regexp_replace(_clean(v["ref"]), REQUEST_NOTE, "")), F.lit(""))
        return F.struct(
            text.alias("text"),
            translation.alias("translation"),
            shown(v["roman"]).alias("roman"),
            F.when(~ref.rlike(REQUEST), ref).alias("ref"),
            F.coalesce(v["type"] == "quotation", F.lit(False)).alias("quotation"),
            emphasis(text, v["text"], v["bold_text_offsets"]).alias("bold"),
            F.when(translation.isNotNull(), emphasis(translation, raw_translation, v["bold_translation_offsets"])).otherwise(_empty(_RANGES)).alias("translation_bold"),
        )

    parsed = F.transform(F.filter(values, lambda v: v.startswith("{")), lambda v: F.from_json(v, _EXAMPLE))
    usage = lambda v: F.coalesce(v["type"] == "example", F.lit(False))
    ordered = _bound(parsed, lambda p: F.concat(F.filter(p, usage), F.filter(p, lambda v: ~usage(v))))
    good = F.filter(F.transform(ordered, made), lambda x: x["text"].isNotNull() & (F.length(x["text"]) <= EXAMPLE_LENGTH) & ~x["text"].contains("'''"))
    kind = f"array<struct<text:string,translation:string,roman:string,ref:string,quotation:boolean,bold:{_RANGES},translation_bold:{_RANGES}>>"

    def step(kept: Column, x: Column) -> Column:
        known = F.exists(kept, lambda k: k["text"] == x["text"])
        return F.when((F.size(kept) == EXAMPLES) | known, kept).otherwise(F.array_append(kept, x))

    return F.coalesce(F.aggregate(good.cast(kind), _empty(kind), step), _empty(kind))


def _label(link: Column) -> Column:
    return F.coalesce(link["label"], link["word"])


def sense_references(sense: Column, lang: Column, anchors: dict[str, str]) -> Column:
    """struct(form_of, alt_of, links) of a sense, each distinct and in order.

    A link of the gloss leads to English unless it names a language. A form or alternative takes the
    link that shows its word, with or without an aspect after it, and its target's spelling; it leads
    to the entry's language and replaces the links that show or target the same word.
    """

    def resolved(values: Column, known: Column) -> Column:
        def one(v: Column) -> Column:
            shows = lambda k: (v["word"] == _label(k)) | v["word"].isin(F.concat(_label(k), F.lit(" pf")), F.concat(_label(k), F.lit(" impf")))
            source = F.get(F.filter(known, shows), 0)
            found = F.struct(source["word"].alias("word"), lang.alias("lang"), source["anchor"].alias("anchor"), source["label"].alias("label"))
            return F.when(source.isNotNull(), found).otherwise(links.word_link(v["word"], lang, F.lit(None).cast("string"), anchors))

        refs = F.filter(F.transform(values, one), lambda r: r.isNotNull())
        return F.coalesce(refs.cast(_LINKS), _empty(_LINKS))

    def rest(refs: Column, known: Column) -> Column:
        other = F.filter(known, lambda k: ~F.exists(refs, lambda r: (r["word"] == k["word"]) | (_label(r) == _label(k))))
        return F.concat(refs, other)

    read = F.transform(sense["links"], lambda p: links.word_link(F.get(p, 1), F.lit("en"), F.get(p, 0), anchors))
    read = F.coalesce(F.filter(read, lambda k: k.isNotNull()).cast(_LINKS), _empty(_LINKS))

    def forms(known: Column) -> Column:
        return _bound(resolved(sense["form_of"], known), lambda refs: F.struct(refs.alias("form_of"), rest(refs, known).alias("links")))

    def alternatives(a: Column) -> Column:
        return _bound(
            resolved(sense["alt_of"], a["links"]),
            lambda refs: F.struct(
                F.array_distinct(a["form_of"]).alias("form_of"),
                F.array_distinct(refs).alias("alt_of"),
                F.array_distinct(rest(refs, a["links"])).alias("links"),
            ),
        )

    return _bound(_bound(read, forms), alternatives)


@cache
def _latin() -> tuple[str, str]:
    """Classes of the characters whose Unicode name says Latin, and of the letters among them and the marks for sounds."""
    named = [p for p in range(sys.maxunicode + 1) if "LATIN" in unicodedata.name(chr(p), "")]

    def ranges(points: list[int]) -> str:
        out: list[list[int]] = []
        for p in points:
            if out and out[-1][1] == p - 1:
                out[-1][1] = p
            else:
                out.append([p, p])
        return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)

    letters = sorted({p for p in named if chr(p).isalpha()} | set(map(ord, "ʿʾʹʺʼ")))
    return ranges(named), ranges(letters)


def romanizations() -> Column:
    """Distinct readings in Latin letters that an entry states for its headword; empty for languages without a profile.

    Cells of tables are no readings, and neither are texts with separators or letters of another script.
    """
    some, letters = _latin()

    def reading(f: Column) -> Column:
        stated = F.coalesce(F.arrays_overlap(f["tags"], F.array(F.lit("romanization"), F.lit("transliteration"))), F.lit(False))
        return F.when(stated, f["form"]).when(f["form"] == F.col("word"), f["roman"])

    def good(x: Column) -> Column:
        return x.isNotNull() & ~x.isin(*DASHES) & ~x.rlike(r"[/,;()\[\]{}<>]") & x.rlike(f"[{some}]") & ~x.rlike(rf"[\p{{L}}&&[^{letters}]]")

    own = F.filter("forms", lambda f: F.coalesce(f["source"], F.lit("")) == "")
    # Repeated texts go before they are cleaned and tested.
    found = F.filter(F.array_distinct(F.transform(F.array_distinct(F.transform(own, reading)), _clean)), good)
    return F.when(F.col("lang_code").isin(*t.ROMANIZATION), F.coalesce(found, _empty("array<string>"))).otherwise(_empty("array<string>"))


def _replaced_once(c: Column, pair: Column) -> Column:
    old, new = F.get(pair, 0), F.get(pair, 1)
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), new, F.substring(c, at + F.length(old), F.length(c)))).otherwise(c)


def entry_readings() -> Column:
    """Distinct (text, label) of an entry's readings: romanised forms, vocalised spellings, kana over the headword, then sounds."""
    lang, word = F.col("lang_code"), F.col("word")
    tagged = lambda f, tag: F.coalesce(F.array_contains(f["tags"], tag), F.lit(False))
    item = lambda text, label: F.struct(_clean(text).alias("text"), label.alias("label"))

    def of_form(f: Column) -> Column:
        vocal = lang.isin("ar", "ur") & tagged(f, "canonical") & (t.strip_diacritics(f["form"]) == t.strip_diacritics(word))
        kana = F.aggregate(F.coalesce(f["ruby"], _empty("array<array<string>>")), word, _replaced_once)
        return F.array(
            item(F.when(tagged(f, "romanization"), f["form"]), F.lit("Romanization")),
            item(F.when(vocal, f["form"]), F.lit("Vocalized spelling")),
            item(F.when((lang == "ja") & tagged(f, "canonical") & (F.size(f["ruby"]) > 0), F.nullif(kana, word)), F.lit("Reading")),
        )

    def of_sound(v: Column) -> Column:
        s = F.from_json(v, "zh_pron string, tags array<string>, other string")
        tags = F.coalesce(F.nullif(F.array_join(s["tags"], ", "), F.lit("")), F.lit("Reading"))
        return F.array(
            item(F.when(lang == "zh", s["zh_pron"]), tags),
            item(F.when((lang == "ja") & s["other"].rlike(KANA), s["other"]), F.lit("Reading")),
        )

    sounds = F.transform(F.filter("sounds", lambda v: v.startswith("{")), of_sound)
    both = F.concat(
        F.coalesce(F.flatten(F.transform("forms", of_form)).cast(_READINGS), _empty(_READINGS)),
        F.coalesce(F.flatten(sounds).cast(_READINGS), _empty(_READINGS)),
    )
    found = F.array_distinct(F.filter(both, lambda x: x["text"].isNotNull() & ~x["text"].rlike(CONTROLS)))
    return F.when(lang.isin(*READING_LANGUAGES), found).otherwise(_empty(_READINGS))


def soft_redirects(entries: DataFrame) -> DataFrame:
    """(src_ord, lang_code, word, targets) of Chinese and Japanese entries that only point to other words; distinct, in order."""
    targets = F.filter(F.transform("redirects", lambda r: _clean(r)), lambda r: r.isNotNull() & (r != F.col("word")))
    rows = entries.where(F.col("lang_code").isin("zh", "ja") & (F.col("pos") == "soft-redirect"))
    return rows.select("src_ord", "lang_code", "word", F.array_distinct(targets).alias("targets")).where(F.size("targets") > 0)


def _array(c: Column) -> Column:
    return F.coalesce(c, _empty("array<string>"))


def enhanced_sense(sense: Column, source: Column, usage: list[str]) -> Column:
    """The sense with the source's labels after its tags, and without examples that list related words or hold broken entities."""
    tags = F.array_distinct(F.concat(_array(sense["tags"]), _array(readings.labels(source["tags"], usage)), _array(readings.raw_labels(source["raw_tags"]))))
    examples = F.filter(sense["examples"], lambda x: ~x["text"].rlike(LINKAGE) & ~x["text"].rlike(BROKEN_ENTITY))
    return sense.withField("tags", tags).withField("examples", examples)


def pronunciations(usage: list[str]) -> Column:
    """Distinct (ipa, label) of the sounds in order; the label joins note, labels and raw labels. Ancient Greek needs a label."""

    def one(v: Column) -> Column:
        s = F.from_json(v, "ipa string, note string, tags array<string>, raw_tags array<string>")
        note = F.filter(F.array(_clean(s["note"])), lambda x: x.isNotNull())
        parts = F.array_distinct(F.concat(note, _array(readings.labels(s["tags"], usage)), _array(readings.raw_labels(s["raw_tags"]))))
        return F.struct(_clean(s["ipa"]).alias("ipa"), F.nullif(F.array_join(parts, ", "), F.lit("")).alias("label"))

    made = F.transform(F.filter("sounds", lambda v: v.startswith("{")), one)
    kept = F.filter(made, lambda x: x["ipa"].isNotNull() & ((F.col("lang_code") != "grc") | x["label"].isNotNull()))
    return F.coalesce(F.array_distinct(kept), _empty("array<struct<ipa:string,label:string>>"))


def head_gender() -> Column:
    """Genders that the headword itself states, in the order m, f, n, c: canonical forms, heads of Nynorsk, else arguments of head templates."""
    canonical = _array(F.flatten(F.transform(F.filter("forms", lambda f: F.coalesce(F.array_contains(f["tags"], "canonical"), F.lit(False))), lambda f: f["tags"])))
    named = F.array(*[F.when(F.array_contains(canonical, tag), F.lit(sign)) for tag, sign in dictionary.GENDER_TAGS.items()])
    heads = F.transform("head_templates", lambda h: F.regexp_extract(h["name"], r"^nn-noun-([mfn])[0-9u]*$", 1))
    heads = F.when(F.col("lang_code") == "nn", _array(heads)).otherwise(_empty("array<string>"))
    stated = F.concat(named, heads)

    def argument(h: Column) -> Column:
        value = F.lit(None).cast("string")
        for name, place in GENDER_ARGUMENTS.items():
            value = F.when(h["name"] == name, F.try_element_at(h["args"], F.lit(place))).otherwise(value)
        return F.when(value.rlike("^[mfn](?:[,-][mfn])*$"), F.split(value, "[,-]")).otherwise(_empty("array<string>"))

    signs = lambda found: F.concat_ws("-", *[F.when(F.array_contains(found, x), F.lit(x)) for x in "mfnc"])
    # Compact: array_contains with nulls gives null where nothing is found, which concat_ws leaves out.
    first = _bound(stated, signs)
    second = _bound(_array(F.flatten(F.transform("head_templates", argument))), signs)
    gender = F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    return F.when(F.col("pos").isin("noun", "name"), gender)


def detailed_records(entries: DataFrame, anchors: dict[str, str], usage: list[str] | None = None) -> DataFrame:
    """Dictionary records with the examples and references of each sense, readings and etymology links.

    With ``usage``, the tags that are labels of usage, records of some languages are enhanced: labels of senses,
    labelled pronunciations, the head's own gender, no broken examples.

    A trusted Persian head stays though its category bars it. Soft redirects are records of their own
    table, see ``soft_redirects``.
    """
    valid = entries.where(dictionary.is_valid(verbs.is_trusted_persian()))
    kept = valid.withColumn("senses", F.filter("senses", lambda s: dictionary.gloss_path(s["glosses"]).isNotNull())).where(F.size("senses") > 0)

    def joined(base: Column, s: Column) -> Column:
        refs = sense_references(s, F.col("lang_code"), anchors)
        made = _bound(refs, lambda r: F.struct(*[base[c].alias(c) for c in ("gloss", "tags", "topics", "qualifier")], usage_examples(s["examples"]).alias("examples"), *[r[c].alias(c) for c in ("form_of", "alt_of", "links")]))
        return made if usage is None else F.when(better, _bound(made, lambda m: enhanced_sense(m, s, usage))).otherwise(made)

    better = F.col("lang_code").isin(*ENHANCED)
    gender, sounds = dictionary.entry_gender(), dictionary.pronunciation()
    spoken = _empty("array<struct<ipa:string,label:string>>")
    if usage is not None:
        gender = F.when(F.col("lang_code").isin(*GENDERLESS), None).when(better, F.coalesce(head_gender(), gender)).otherwise(gender)
        all_ = pronunciations(usage)
        sounds = F.when(better, F.get(all_, 0)["ipa"]).otherwise(sounds)
        spoken = F.when(better & ((F.size(all_) > 1) | F.exists(all_, lambda x: x["label"].isNotNull())), all_).otherwise(spoken)
    return kept.select(
        "src_ord",
        "lang_code",
        "word",
        "pos",
        F.zip_with(dictionary.senses(F.col("senses")), F.col("senses"), joined).alias("senses"),
        dictionary.summary_gloss(F.col("senses")).alias("gloss"),
        gender.alias("gender"),
        dictionary.distinct_forms().alias("forms"),
        sounds.alias("pronunciation"),
        spoken.alias("pronunciations"),
        dictionary.etymology().alias("etymology"),
        links.etymology_links(F.col("etymology_templates"), anchors).alias("etymology_links"),
        romanizations().alias("romanizations"),
        entry_readings().alias("readings"),
        *[dictionary.relations(F.col(c), F.col("word")).alias(c) for c in ("synonyms", "antonyms", "related", "derived")],
    )
