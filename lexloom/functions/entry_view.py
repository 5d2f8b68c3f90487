"""What a reader sees of an entry: labels, groups of forms, readings, link targets and free-text filters.

Columns of one row; a null array counts as empty, a null text as no text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that keep their hyphen, raised ordinals, groups of forms in their order, and kinds of languages without entries.
HYPHENATED = ("Navarro-Lapurdian", "Vivaro-Alpine")
RAISED = {"ˢᵗ": "st", "ⁿᵈ": "nd", "ʳᵈ": "rd", "ᵗʰ": "th"}
GROUPS = {"inflection": "Inflections", "variant": "Spelling variants", "related": "Related formations", "other": "Other forms"}
NO_ENTRIES = ("family", "reconstructed", "special")

_TEXTS = "array<string>"


def _list(c: Column, kind: str = _TEXTS) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def usage_label(tag: Column) -> Column:
    """A tag as it is shown: hyphens part words, but for names that have one."""
    return F.when(tag.isin(*HYPHENATED), tag).otherwise(F.replace(tag, F.lit("-"), F.lit(" ")))


def pronunciation_label(label: Column) -> Column:
    """A label with ordinals on the line."""
    for raised, plain in RAISED.items():
        label = F.replace(label, F.lit(raised), F.lit(plain))
    return label


def shown_pronunciations(listed: Column, single: Column) -> Column:
    """The listed array<struct<ipa, label>>, or the single sound of an older record; equal sounds with own labels all stay."""
    older = F.array(F.struct(single.alias("ipa"), F.lit(None).cast("string").alias("label")))
    none = F.array().cast("array<struct<ipa:string,label:string>>")
    return F.when(F.size(_list(listed, "array<struct<ipa:string,label:string>>")) > 0, listed).when(F.coalesce(single, F.lit("")) != "", older).otherwise(none)


def _of_form(details: Column, form: Column) -> Column:
    return F.filter(details, lambda d: d["form"].eqNullSafe(form))


def form_readings(details: Column) -> Column:
    """array<struct<form, labels, readings>> of array<struct<form, kind, tags, readings: array<struct<grammar, qualifiers>>>>.

    Forms stand in the order of their first detail. ``labels`` joins the distinct labels of the form's tags. A
    reading is its grammar, then its qualifiers behind a dot; equal ones are shown once. A form without
    readings has its labels as one reading, if there are any.
    """

    def reading(r: Column) -> Column:
        grammar = F.array_join(F.transform(_list(r["grammar"]), usage_label), " ")
        qualifiers = F.array_join(F.transform(_list(r["qualifiers"]), usage_label), ", ")
        return F.array_join(F.filter(F.array(grammar, qualifiers), lambda x: x != ""), " · ")

    def each(form: Column) -> Column:
        own = _of_form(details, form)
        labels = F.array_join(F.array_distinct(F.flatten(F.transform(own, lambda d: F.transform(_list(d["tags"]), usage_label)))), ", ")
        kinds = "array<struct<grammar:array<string>,qualifiers:array<string>>>"
        said = F.array_distinct(F.filter(F.flatten(F.transform(own, lambda d: F.transform(_list(d["readings"], kinds), reading))), lambda x: x != ""))
        shown = F.when(F.size(said) > 0, said).when(labels != "", F.array(labels)).otherwise(F.array().cast(_TEXTS))
        return F.struct(form.alias("form"), labels.alias("labels"), shown.alias("readings"))

    made = F.transform(F.array_distinct(F.transform(details, lambda d: d["form"])), each)
    return _list(made, "array<struct<form:string,labels:string,readings:array<string>>>")


def form_groups(details: Column, forms: Column) -> Column:
    """array<struct<label, forms>>: an entry's forms by kind, in the order of kinds; without a known kind they are others.

    Of several details of one form the last one's kind holds. Empty groups are left out.
    """

    def kind(form: Column) -> Column:
        own = _of_form(details, form)
        return F.coalesce(F.get(own, F.size(own) - 1)["kind"], F.lit("other"))

    def group(rows: Column, name: str, label: str) -> Column:
        own = F.transform(F.filter(rows, lambda x: x["kind"] == name), lambda x: x["form"])
        return F.struct(F.lit(label).alias("label"), own.alias("forms"))

    kinds = F.transform(_list(forms), lambda f: F.struct(f.alias("form"), kind(f).alias("kind")))
    made = F.transform(F.array(kinds), lambda rows: F.array(*[group(rows, *g) for g in GROUPS.items()]))
    return F.filter(F.flatten(made), lambda g: F.size(g["forms"]) > 0)


def url_component(c: Column) -> Column:
    """A text as a part of an address; letters, digits and ``-_.!~*'()`` stay."""
    for coded, plain in {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}.items():
        c = F.replace(c if coded != "+" else F.url_encode(c), F.lit(coded), F.lit(plain))
    return c


def local_language(word: Column, code: Column, kind: Column, installed: Column) -> Column:
    """The language under whose entries a link is opened, or null: reconstructions, namespaces and languages not installed stay outside."""
    closed = word.startswith("*") | word.contains(":") | F.coalesce(kind.isin(*NO_ENTRIES), F.lit(False))
    return F.when(~closed & F.coalesce(installed, F.lit(False)), code)


def external_url(base: str, word: Column, *anchors: Column) -> Column:
    """The address of a word's page, at the first anchor that says something."""
    anchor = F.coalesce(*[F.nullif(a, F.lit("")) for a in anchors], F.lit(""))
    return F.concat(F.lit(base), url_component(word), F.when(anchor != "", F.concat(F.lit("#"), url_component(anchor))).otherwise(""))


def matches_filter(typed: Column, *fields: Column) -> Column:
    """Whether the fields, joined by spaces, hold the typed text in any case; nothing typed matches all."""
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))
    return whole.contains(F.lower(F.trim(F.coalesce(typed, F.lit("")))))
