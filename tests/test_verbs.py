"""Verb roots, form filters and readings on entries written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import readings, verbs
from lexloom.sources import jsonl

BASE = {"pos": "verb", "lang_code": "fr", "lang": "French", "word": "aller", "senses": [{"glosses": ["to go"]}]}


@pytest.fixture(scope="module")
def entries(spark):
    return lambda *changes: jsonl.parse_entries(spark.createDataFrame([(json.dumps(BASE | c), "f", i) for i, c in enumerate(changes)], "value string, file string, src_ord long"))[0]


def test_verb_roots(entries):
    form_of = [{"glosses": ["x"], "tags": ["form-of"]}]
    cases = [
        ({}, True),
        ({"pos": "noun"}, False),
        ({"word": "s'aller"}, False),
        ({"word": "-er"}, False),
        ({"senses": form_of}, False),
        ({"senses": form_of + BASE["senses"]}, True),
        ({"senses": []}, True),
        ({"categories": ["French verb forms"]}, False),
        ({"categories": [{"name": "French idioms"}]}, False),
        ({"senses": [{"glosses": ["x"], "categories": ["French idioms"]}]}, False),
        ({"etymology_templates": [{"name": "abbrev"}]}, False),
        ({"lang_code": "el", "lang": "Greek", "head_templates": [{"name": "el-part"}]}, False),
        ({"lang_code": "la", "lang": "Latin", "categories": ["Latin verb forms"], "head_templates": [{"name": "la-verb"}]}, True),
        ({"lang_code": "sv", "lang": "Swedish", "categories": ["Swedish verb forms"], "head_templates": [{"name": "head", "args": {"1": "sv", "2": "verb"}}]}, True),
        ({"categories": ["French verb forms"], "head_templates": [{"name": "fr-verb"}]}, False),
    ]
    rows = entries(*[c for c, _ in cases]).select("src_ord", verbs.is_verb_root().alias("x")).orderBy("src_ord").collect()
    assert [r.x for r in rows] == [want for _, want in cases]


def test_heads_and_scripts(entries):
    fa = {"lang_code": "fa", "lang": "Persian", "word": "رفتن", "head_templates": [{"name": "fa-verb"}]}
    rows = entries(fa, fa | {"word": "raftan"}, fa | {"head_templates": []}, {"categories": [verbs.ASPIRATED]}, {"senses": [{"glosses": ["x"], "categories": [verbs.ASPIRATED]}]})
    got = rows.select("src_ord", verbs.is_trusted_persian().alias("a"), verbs.is_aspirated().alias("b")).orderBy("src_ord").collect()
    assert [(r.a, r.b) for r in got] == [(True, False), (False, False), (False, False), (False, True), (False, True)]


FORMS = [
    # language, form, tags, kept
    ("fr", "vais", ["present"], True), ("fr", "me suis", [], False), ("fr", "t'es", [], False), ("fr", "/va/", [], False), ("fr", "vɛ", [], False), ("fr", None, [], False),
    ("de", "habe gemacht", ["multiword-construction"], True), ("de", "haben + Partizip", ["multiword-construction"], False), ("el", "a - b", [], True), ("el", "x{y}", [], False),
    ("de", "mache", ["negative"], False), ("de", "no-table-tags", [], False), ("fi", "en tule", ["negative"], True), ("la", "amātus est (masculine)", [], True), ("la", "see 1", [], False), ("la", "—", [], False),
    ("nl", "bel op", ["main-clause"], True), ("nl", "bel op", [], False), ("nl", "1", [], False), ("sv", "hutar åt", ["indicative"], True), ("sv", "hutar", [], False),
    ("sv", "sms:ar", ["indicative"], True), ("sv", "abc:1", ["indicative"], False), ("pt", "falámos (Portugal)", [], True), ("pt", "fala se", [], False), ("pt", "falar (note)", [], False),
    ("ca", "col·laborar", [], True), ("ca", "vaig anar", ["periphrastic"], True), ("ca", "puc anar", ["periphrastic"], False), ("ca", "·", [], False),
]


def test_form_filters(spark):
    rows = [(i, lang, [(form, "conjugation", tags), (form, "other", tags)]) for i, (lang, form, tags, _) in enumerate(FORMS)]
    df = spark.createDataFrame(rows, "i long, lang string, forms array<struct<form:string,source:string,tags:array<string>>>")
    got = df.select("i", F.size(verbs.clean_forms(F.col("forms"), F.col("lang"))).alias("n")).orderBy("i").collect()
    assert [(FORMS[r.i][:2], r.n) for r in got] == [(x[:2], int(x[3])) for x in FORMS]


def test_first_tables_and_ids(entries):
    forms = [{"form": x, "source": "conjugation", "tags": ["table-tags"] if x == "t" else []} for x in ("t", "a", "t", "b", "t", "c")]
    rows = entries({"forms": forms}, {"forms": forms, "lang_code": "el", "lang": "Greek", "word": "βρίσκω"}, {"word": "Étre"}, {"word": "etre"})
    got = verbs.verb_forms(rows, {"fr": 2}).orderBy("src_ord", "pos").collect()
    assert [(r.lang_code, r.form) for r in got] == [("fr", "a"), ("el", "a"), ("el", "b"), ("el", "c")]
    ids = {r.word: r.id for r in verbs.verb_ids(rows.select("src_ord", "lang_code", "word")).collect()}
    assert ids == {"Étre": 0, "aller": 1, "etre": 2, "βρίσκω": 0}


VOCABULARY = readings.Vocabulary(
    ("first-person", "third-person", "past", "historic", "future", "future-i", "singular", "plural", "object-first-person", "object-singular", "singular-possessive", "possessed-many"),
    usage=frozenset({"rare"}), related=frozenset({"noun"}), variants=frozenset({"alternative"}), internal=frozenset({"class"}), display={"historic": "past historic"},
)


@pytest.mark.parametrize(
    "tags, want",
    [
        (["historic", "past", "third-person"], (["third person", "past historic"], [], "inflection", [])),
        (["future-i", "future", "object-singular", "object-first-person"], (["future i", "object: first person singular"], [], "inflection", [])),
        (["singular-possessive", "first-person", "plural"], (["plural", "possessor: first person singular"], [], "inflection", [])),
        (["possessed-many", "plural", "first-person"], (["possessed many", "possessor: first person plural"], [], "inflection", [])),
        (["noun", "rare", "New-York"], ([], ["noun", "New York", "rare"], "related", [])),
        (["diminutive", "plural"], (["plural"], [], "related", ["diminutive"])),
        (["alternative", "class", "zzz", "error-x", "Abc d"], ([], [], "variant", ["zzz"])),
        ([], ([], [], "other", [])),
        (None, ([], [], "other", [])),
    ],
)
def test_reading(spark, tags, want):
    row = spark.createDataFrame([(tags,)], "tags array<string>").select(readings.reading(F.col("tags"), VOCABULARY).alias("r")).first()["r"]
    assert tuple(row) == want


def test_details(spark):
    rows = [(1, 0, "a", ["past"], None), (1, 1, "b", ["plural"], ["of \"men", "(x"]), (1, 2, "a", ["third-person", "past"], []), (1, 3, "a", ["past", "third-person"], []), (1, 4, "c", None, None), (2, 0, None, ["past"], None)]
    df = spark.createDataFrame(rows, "e long, pos long, form string, tags array<string>, raw_tags array<string>")
    got = [(r.form, r.kind, [tuple(x) for x in r.readings]) for r in readings.form_details(df, ["e"], VOCABULARY).orderBy("e", "pos").collect()]
    assert got == [("a", "inflection", [(["third person", "past"], [])]), ("b", "inflection", [(["plural"], ["of men"])]), ("c", "other", [])]
    assert readings.unknown_tags(df.withColumn("lang", F.lit("x")), "lang", readings.Vocabulary(("plural",))).where("tag = 'past'").first()["n"] == 4
