"""Reasons, person columns and spelling variants on forms written by hand."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import form_quality as fq
from lexloom.operators.conjugation import FORMS

SCHEMA = "k int, lang string, pos string, text string, tags array<string>, source string, heads array<struct<name:string,expansion:string>>"


@pytest.fixture(scope="module")
def normal(spark):
    def run(*rows):
        """(lang, text, tags, source, pos, heads) -> (reason, [(form, qualifiers)])."""
        full = []
        for k, (lang, text, *rest) in enumerate(rows):
            tags, source, pos, heads = (*rest, *("", "conjugation", "verb", [])[len(rest) :])
            full.append((k, lang, pos, text, tags.split() if tags is not None else None, source, heads))
        df = spark.createDataFrame(full, SCHEMA)
        found = df.select("k", fq.normalized(*(F.col(c) for c in ("lang", "pos", "text", "tags", "source", "heads"))).alias("x")).orderBy("k").collect()
        return [(r.x.reason, [(v.form, v.qualifiers) for v in r.x.variants]) for r in found]

    return run


def test_reasons_in_order(normal):
    cases = [
        (("lv", "conjugation", "first-person"), "table-header"),
        (("lv", "a|b=c"), "unexpanded-template"),
        (("lv", "es"), "table-pronoun"),
        (("lv", "es", "", "declension"), None),
        (("lv", "conjugation", "first-person", "conjugation", "verb", [("lv-part", "x|#default=y")]), "broken-paradigm"),
        (("nn", "since 1938"), "usage-note"),
        (("nn", "since 19388"), None),
        (("tl", "superseded", "alternative"), "usage-note"),
        (("tl", "superseded"), None),
        (("bg", "бях + x"), "unexpanded-template"),
        (("bg", "бях + x", "", "head"), None),
        (("xx", "?"), "placeholder"),
        (("fr", "present indicative of avoir + past participle"), "construction-instruction"),
        (("fr", "ayant", "multiword-construction"), "detached-auxiliary"),
        (("it", "infinitive", "", "declension"), "table-header"),
        (("it", "the sense of x"), "auxiliary-note"),
        (("la", "First-declension noun."), "declension-note"),
        (("ru", "not used"), "unavailable-form"),
        (("ko", "Formed using x"), "construction-instruction"),
        (("id", "nonstandard Malay"), "language-note"),
        (("sv", "literally x", "literally"), "translation"),
        (("ru", "Full stop", "error-unrecognized-form"), "foreign-table-cell"),
        (("de", "pronunciation: x"), "pronunciation-note"),
        (("uk", "znaty"), "transliteration-in-table"),
        (("uk", "знати"), None),
        (("el", None, None, None, None, None), None),
        ((None, "plain", None, None, None, None), None),
    ]
    assert [r for r, _ in normal(*(c for c, _ in cases))] == [want for _, want in cases]


def test_greek_variants(normal):
    cases = [
        ("θα απαντιέμαι - {απαντώμαι}", [("θα απαντιέμαι", []), ("θα απαντώμαι", ["learned", "archaic"])]),
        ("[ευχαριστούμουν]", [("ευχαριστούμουν", ["rare"])]),
        ("(‑ούσαστε)]", []),
        ("λύουσι(ν)", [("λύουσι(ν)", [])]),
        ("[{λύω}, (λύνω)]", [("λύω", ["rare", "learned", "archaic"]), ("λύνω", ["rare", "optional or informal"])]),
        ("λύω / λύνω", [("λύω", []), ("λύνω", [])]),
        ("λύω (x)", []),
        ("-ω", []),
        ("λύω¹", []),
        ("abc", []),
    ]
    got = normal(*(("el", text) for text, _ in cases))
    assert [v for _, v in got] == [want for _, want in cases]
    assert normal(("el", "-ω", "", "conjugation", "suffix"))[0][1] == [("-ω", [])]


def test_variants_of_other_languages(normal):
    cases = [
        (("hu", "ad or adsz"), [("ad", []), ("adsz", [])]),
        (("hu", "adnék (or adnám)"), [("adnék", []), ("adnám", [])]),
        (("hu", "adsz or"), [("adsz", [])]),
        (("hu", "{x"), []),
        (("da", "(have/være) gået"), [("gået", ["auxiliary: have / være"])]),
        (("br", "graet (auxiliary verb: bezañ)"), [("graet", ["auxiliary: bezañ"])]),
        (("is", "conjugation: a – b"), [("a", []), ("b", [])]),
        (("it", "(rare) cosse m"), [("cosse", ["rare"])]),
        (("he", "מלה (formal)"), [("מלה", ["formal"])]),
        (("ka", "abc კ"), []),
        (("gd", "bha (archaic)"), [("bha", ["archaic"])]),
        (("nn", "(alternative case) han"), [("han", ["alternative case"])]),
        (("de", "gehe>"), [("gehe", [])]),
        (("fr", "a, b", "alternative"), [("a", []), ("b", [])]),
        (("fr", "a, b c", "alternative"), [("a, b c", [])]),
        (("fr", "a, b", "alternative", "x", "phrase"), [("a, b", [])]),
        (("en", "a, b", "alternative"), [("a, b", [])]),
    ]
    assert [v for _, v in normal(*(c for c, _ in cases))] == [want for _, want in cases]


def brute_columns(forms):
    out, k = [], 0
    persons = set(fq.PERSON_TAGS)
    key = lambda f: (f["source"], set(f["tags"]) - persons)
    known = [[set(c) for c in layout] for layout in fq.LAYOUTS]
    while k < len(forms):
        end = k
        while end < len(forms) and key(forms[end]) == key(forms[k]):
            end += 1
        run = forms[k:end]
        if run[0]["source"] != "conjugation" or not key(run[0])[1] & set(fq.FINITE):
            out += run
        else:
            rows = [run[i : i + 6] for i in range(0, len(run), 6)]
            good = all([set(f["tags"]) & persons for f in row] in known for row in rows)
            out += [f | {"tags": sorted((set(f["tags"]) - persons) | (set(fq.COLUMNS[i]) if good else set()))} for row in rows for i, f in enumerate(row)]
        k = end
    return out


def test_person_columns(spark):
    row = lambda layout, more, source="conjugation": [{"form": f"{more}{i}", "tags": sorted([*c, more]), "source": source} for i, c in enumerate(layout)]
    a, b, c = fq.LAYOUTS
    tables = [
        row(a, "aorist"), row(b, "aorist"), row(c, "past"), row(b, "aorist") + row(c, "aorist"), row(b, "aorist") + row(a, "aorist")[:3], row(a, "aorist")[:5], row(b, "present"), row(b, "aorist", "head"),
        [], row(b, "past") + row(b, "future") + row(a, "infinitive"), [{"form": None, "tags": ["aorist"], "source": None}],
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(tables)], f"k int, forms {FORMS}")
    got = [[f.asDict() for f in r.x] for r in df.select("k", fq.person_columns(F.col("forms")).alias("x")).orderBy("k").collect()]
    assert got == [brute_columns(t) for t in tables]
