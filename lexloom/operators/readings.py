"""Readings of inflected forms: tag sets to grammar, qualifiers and kind, and the readings of each spelling.

The vocabulary of tags is configuration: it is a parameter here, of a few hundred tags. Tags repeat
the same few thousand sets, so each distinct set is read once and met by an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.operators.forms import reading_kind, unsubsumed

# Components that a more specific tag makes redundant, and tags that decide or are folded.
REDUNDANT = {
    "past": ("historic",),
    "middle": ("middle-voice",),
    "future": ("future-i", "future-ii"),
    "subjunctive": ("subjunctive-i", "subjunctive-ii"),
    "conditional": ("conditional-i", "conditional-ii"),
}
ALWAYS_RELATED = ("derived", "relational", "diminutive", "augmentative", "abstract-noun", "adjective-from-noun", "noun-from-verb")
PEOPLE = ("first-person", "second-person", "third-person")
NUMBERS = ("singular", "plural")
POSSESSORS = ("singular-possessive", "plural-possessive")
POSSESSED = ("possessed-single", "possessed-many")


@dataclass(frozen=True)
class Vocabulary:
    """Known tags: grammar in the order in which it is shown, and the sets of the other kinds."""

    grammar: tuple[str, ...]
    usage: frozenset[str] = frozenset()
    related: frozenset[str] = frozenset()
    variants: frozenset[str] = frozenset()
    internal: frozenset[str] = frozenset()
    display: dict[str, str] = field(default_factory=dict)


def _array(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _plain(tag: Column) -> Column:
    return F.replace(tag, F.lit("-"), F.lit(" "))


def reading(tags: Column, vocabulary: Vocabulary) -> Column:
    """struct(grammar, qualifiers, kind, unknown) of a set of tags; null counts as none.

    Objects and possessors are folded into one label each, which takes the person and number that
    they consume; labels follow the vocabulary's order, qualifiers and unknown tags that of their names.
    """
    tags = F.array_sort(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>"))))
    has = lambda *x: F.arrays_overlap(tags, _array(x))
    among = lambda values: F.filter(_array(values), lambda x: F.array_contains(tags, x))
    known = among(vocabulary.grammar)
    objects = F.filter(known, lambda x: x.startswith("object-"))
    owned, counted = has(*POSSESSORS, *POSSESSED), has(*POSSESSED)
    owners = F.filter(_array(NUMBERS), lambda n: F.array_contains(tags, F.concat(n, F.lit("-possessive"))))
    numbers = F.when((F.size(owners) == 0) & counted, among(NUMBERS)).otherwise(owners)
    none = F.array().cast("array<string>")
    folded = F.concat(
        objects,
        F.when(owned, F.concat(_array(PEOPLE), _array(POSSESSORS))).otherwise(none),
        F.when(counted, numbers).otherwise(none),
        *[F.when(has(*by), F.array(F.lit(tag))).otherwise(none) for tag, by in REDUNDANT.items()],
    )
    left = F.filter(known, lambda x: ~F.array_contains(folded, x))
    if vocabulary.display:
        shown = F.create_map(*[F.lit(x) for pair in vocabulary.display.items() for x in pair])
        labels = F.transform(left, lambda x: F.coalesce(F.try_element_at(shown, x), _plain(x)))
    else:
        labels = F.transform(left, _plain)
    of_objects = F.concat(F.lit("object: "), F.array_join(F.transform(objects, lambda x: _plain(F.regexp_replace(x, "^object-", ""))), " "))
    of_owner = F.concat(F.lit("possessor: "), F.array_join(F.concat(F.transform(among(PEOPLE), _plain), numbers), " "))
    grammar = F.concat(labels, F.when(F.size(objects) > 0, F.array(of_objects)).otherwise(none), F.when(owned, F.array(of_owner)).otherwise(none))
    usage, in_grammar = _array(sorted(vocabulary.usage)), _array(vocabulary.grammar)
    named = lambda x: F.array_contains(usage, x) | x.rlike(r"^\p{Lu}[\p{L}\p{N}_-]*$")
    qualifiers = F.transform(F.filter(tags, lambda x: named(x) & ~F.array_contains(in_grammar, x)), _plain)
    relations = among(sorted(vocabulary.related))
    kind = (
        F.when(has(*ALWAYS_RELATED), "related")
        .when(F.size(grammar) > 0, "inflection")
        .when(F.size(relations) > 0, "related")
        .when(F.size(among(sorted(vocabulary.variants))) > 0, "variant")
        .otherwise("other")
    )
    qualifiers = F.when(kind == "related", F.array_distinct(F.concat(F.transform(relations, _plain), qualifiers))).otherwise(qualifiers)
    listed = _array(sorted({*vocabulary.grammar} | vocabulary.usage | vocabulary.related | vocabulary.variants | vocabulary.internal))
    unknown = F.filter(F.array_except(tags, listed), lambda x: ~x.startswith("error-") & ~x.rlike(r"^\p{Lu}"))
    return F.struct(grammar.alias("grammar"), qualifiers.alias("qualifiers"), kind.alias("kind"), unknown.alias("unknown"))


def labels(tags: Column, usage: list[str]) -> Column:
    """Distinct labels of usage among the tags, and names (places, periods, scripts: one word with a capital), in order of the tags."""
    named = F.filter(F.array_sort(F.array_distinct(tags)), lambda x: x.isin(*usage) | x.rlike(r"^\p{Lu}[\p{L}\p{N}_-]*$"))
    return F.array_distinct(F.transform(named, _plain))


def raw_labels(tags: Column) -> Column:
    """Distinct clean source labels of 160 characters or fewer; unmatched quotes go, unmatched brackets drop the label."""
    count = lambda x, sign: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))
    clean = F.filter(F.transform(tags, t.clean_text), lambda x: x.isNotNull() & (F.length(x) <= 160) & ~x.rlike(r"[\[\]<>]|error-"))
    even = F.transform(clean, lambda x: F.when(count(x, '"') % 2 == 1, F.replace(x, F.lit('"'), F.lit(""))).otherwise(x))
    return F.array_distinct(F.filter(even, lambda x: count(x, "(") == count(x, ")")))


def form_details(forms: DataFrame, keys: list[str], vocabulary: Vocabulary) -> DataFrame:
    """(keys, form, pos, kind, readings): each spelling of an entry with its distinct readings in order.

    ``forms`` has the keys, pos, form, tags and raw_tags. A reading whose grammar is a strict part of
    another's goes; ``readings`` holds those that say something; ``pos`` is the spelling's first place.
    """
    tidy = forms.where("form is not null").withColumn("tags", F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))))
    sets = tidy.select("tags").distinct().withColumn("r", reading(F.col("tags"), vocabulary))
    rows = tidy.join(sets, "tags").withColumn("more", F.coalesce(raw_labels(F.col("raw_tags")), F.array().cast("array<string>")))
    value = F.struct("r.grammar", F.array_distinct(F.concat("r.qualifiers", "more")).alias("qualifiers"), "r.kind")
    firsts = rows.withColumn("value", value).groupBy(*keys, "form", "value").agg(F.min("pos").alias("pos"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    per_form = firsts.groupBy(*keys, "form").agg(F.min("pos").alias("pos"), ordered.alias("all"))
    per_form = per_form.withColumn("all", unsubsumed(F.col("all"), "grammar", "qualifiers", "kind"))
    said = F.transform(F.filter("all", lambda r: (F.size(r["grammar"]) > 0) | (F.size(r["qualifiers"]) > 0)), lambda r: F.struct(r["grammar"].alias("grammar"), r["qualifiers"].alias("qualifiers")))
    kind = reading_kind(F.transform("all", lambda r: r["kind"]))
    return per_form.select(*keys, "form", "pos", kind.alias("kind"), F.array_distinct(said).alias("readings"))


def unknown_tags(forms: DataFrame, lang: str, vocabulary: Vocabulary) -> DataFrame:
    """(lang, tag, n): how often each tag outside the vocabulary is used; counted by tag set first."""
    counts = forms.groupBy(lang, F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias("tags")).agg(F.count("*").alias("n"))
    return counts.select(lang, "n", F.explode(reading(F.col("tags"), vocabulary)["unknown"]).alias("tag")).groupBy(lang, "tag").agg(F.sum("n").alias("n"))
