"""Repairs of verb tables and cells of paradigms, on entries written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import conjugation as cj
from lexloom.plans import paradigms
from lexloom.sources import jsonl

NAMES = {"el": "Greek", "de": "German", "la": "Latin", "fi": "Finnish", "pt": "Portuguese", "ca": "Catalan", "fr": "French", "sv": "Swedish", "nl": "Dutch", "es": "Spanish", "en": "English", "it": "Italian"}


def form(text, tags, source="conjugation"):
    return {"form": text, "tags": tags.split(), "source": source}


@pytest.fixture(scope="module")
def table(spark):
    """(code, word, forms, more) -> tense name -> cells."""

    def run(code, word, forms, **more):
        entry = {"pos": "verb", "lang_code": code, "lang": NAMES[code], "word": word, "senses": [{"glosses": ["to test"]}], "forms": forms} | more
        lines = spark.createDataFrame([(json.dumps(entry), "f", 0)], "value string, file string, src_ord long")
        rows = cj.conjugations(jsonl.parse_entries(lines)[0], code).collect()
        return dict(zip((x.name for x in paradigms.tenses(code)), rows[0].conjugation)) if rows else None

    return run


@pytest.fixture(scope="module")
def column(spark):
    def run(value, kind, of):
        return spark.createDataFrame([(value,)], f"x {kind}").select(of(F.col("x")).alias("y")).first()["y"]

    return run


@pytest.mark.parametrize(
    "text,want",
    [
        ("[(a)]", ("[(", "a", ")]")), ("[(a]", ("[", "(a", "]")), ("{a", ("", "{a", "")), ("()", ("(", "", ")")), ("(", ("", "(", "")), ("[[{(x)}]]", ("[[{(", "x", ")}]]")), ("a", ("", "a", "")), ("", ("", "", "")),
    ],
)
def test_balanced_markers(column, text, want):
    assert tuple(column(text, "string", cj.balanced_markers)) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("ευχαριστιέμαι¹ - ευχαριστούμαι", ["ευχαριστιέμαι", "ευχαριστούμαι"]),
        ("αγαπιόμασταν (‑ιόμαστε)", ["αγαπιόμασταν"]),
        ("[foo, (-bar)]", ["[foo]"]),
        ("[foo, bar]", ["[foo]", "[bar]"]),
        ("foo - (-ιόσαστε) - —", ["foo"]),
        ("—", []),
        ("foo, bar", ["foo, bar"]),
    ],
)
def test_greek_parts(column, text, want):
    assert column([form(text, "x")], cj.FORMS, lambda c: F.transform(cj.greek_forms(c), lambda f: f["form"])) == want


def test_greek_doubled_bracket(column):
    text = "[αρνούσασταν, [-ούσαστε] - αρνιόσασταν, (-ιόσαστε)"
    got = lambda tags: column([form(text, tags)], cj.FORMS, lambda c: F.transform(cj.greek_forms(c), lambda f: f["form"]))
    assert got("imperfect plural second-person") == ["[αρνούσασταν]", "[αρνούσαστε]", "αρνιόσασταν", "(αρνιόσαστε)"]
    assert got("plural") != got("imperfect plural second-person")
    assert column([{"form": None, "tags": [], "source": "x"}], cj.FORMS, cj.greek_forms)[0]["form"] is None


@pytest.mark.parametrize(
    "cell,want",
    [
        (["λύνουμε", "-ομε"], ["λύνουμε", "λύνομε"]),
        (["θα λύνουμε", "[θα -ομε]"], ["θα λύνουμε", "[θα λύνομε]"]),
        (["αγαπιόμασταν", "(-ιόμαστε)"], ["αγαπιόμασταν", "(αγαπιόμαστε)"]),
        (["λυμένος", "-η", "-ο"], ["λυμένος", "λυμένη", "λυμένο"]),
        (["λύνω", "-ομε"], ["λύνω", "-ομε"]),
        (["αγαπούμασταν", "[αγαπιόμασταν]", "-ούμαστε"], ["αγαπούμασταν", "[αγαπιόμασταν]", "αγαπούμαστε"]),
        (["-ομε", "λύνουμε"], ["-ομε", "λύνουμε"]),
        ([], []),
    ],
)
def test_greek_cell(column, cell, want):
    assert column(cell, "array<string>", cj.greek_cell) == want


@pytest.mark.parametrize(
    "cell,want",
    [
        (["gingst", "gingest"], ["gingst", "{gingest}"]),
        (["gingest", "gingst"], ["gingst", "{gingest}"]),
        (["seist gegangen", "seiest gegangen"], ["seist gegangen", "{seiest gegangen}"]),
        (["macht", "machet"], ["macht", "{machet}"]),
        (["ging", "gang"], ["ging", "gang"]),
        (["t", "et"], ["t", "et"]),
        (["a st", "b est"], ["a st", "b est"]),
        (["gingst"], ["gingst"]),
        (["x", "gingst", "gingest"], ["x", "gingst", "gingest"]),
    ],
)
def test_german_cell(column, cell, want):
    assert column(cell, "array<string>", cj.german_cell) == want


def test_greek_table(table):
    own = "indicative imperfective active present first-person"
    got = table("el", "λύνω", [form("λύνω", f"{own} singular"), form("λύνουμε, [-ομε] - foo (x)", f"{own} plural"), form("λύνουμε", f"{own} plural rare"), form("παλιό", f"{own} singular dated"), form("no", f"{own} singular", "declension")])
    assert got["el_indic_pres_active"][0] == "λύνω" and got["el_indic_fut_cont_active"][0] == "θα λύνω"
    assert got["el_indic_pres_active"][3] == "foo/[λύνουμε]"  # the part with a comma and a space is no clean form
    assert got["el_indic_pres_passive"] == [""] * 6 and got["el_impers_inf_aorist_active"] == [""]


def test_latin_recipes(table):
    perfect = "indicative passive perfect"
    forms = [form("amātus + present active indicative of sum", perfect), form("amātus + unknown form of sum", perfect), form("amō", "first-person singular present indicative active")]
    got = table("la", "amo", forms)
    assert got["la_indic_pres_active"][0] == "amō"
    assert got["la_indic_perf_passive"][0] == "amātus sum (masculine)/amāta sum (feminine)/amātum sum (neuter)"
    assert got["la_indic_perf_passive"][3] == "amātī sumus (masculine)/amātae sumus (feminine)/amāta sumus (neuter)"
    only = table("la", "amo", [form("amātus + present active indicative of sum", f"{perfect} third-person plural")])
    assert only["la_indic_perf_passive"] == ["", "", "", "", "", "amātī sunt (masculine)/amātae sunt (feminine)/amāta sunt (neuter)"]
    future = table("la", "amo", [form("amātus + future active indicative of sum", f"{perfect} future")])
    assert "amātae erunt (feminine)" in future["la_indic_fut_perf_passive"][5] and future["la_indic_perf_passive"] == [""] * 6


def test_latin_shared_recipe_and_compounds(table):
    tags = "indicative active perfect"
    participles = [form("secūtus", "perfect participle active"), form("sequūtus", "perfect participle active")]
    shared = [form("secūtus", tags), form("sequūtus + present active indicative of sum", tags)]
    got = table("la", "sequor", [*shared, *participles])
    assert got["la_indic_perf_active"][3].split("/")[1] == "secūtae sumus (feminine)" and "sequūtae sumus (feminine)" in got["la_indic_perf_active"][3]
    apart = [form("secūtus", tags), form("x", "present"), form("sequūtus + present active indicative of sum", tags)]
    assert "secūtae" not in table("la", "sequor", [*apart, *participles])["la_indic_perf_active"][3]
    compounds = [form("ausus sum", f"{tags} first-person singular"), form("ausī erint", f"{tags} future third-person plural"), form("ausus est", f"{tags} first-person plural"), form("ausus", "perfect participle active")]
    got = table("la", "audeo", compounds)
    assert got["la_indic_perf_active"][0] == "ausus sum (masculine)/ausa sum (feminine)/ausum sum (neuter)"
    assert got["la_indic_fut_perf_active"][5] == "[ausī erint (masculine)]/[ausae erint (feminine)]/[ausa erint (neuter)]"
    assert table("la", "sum", [form("siem", "first-person singular present subjunctive active")])["la_subj_pres_active"][0] == "[siem]"
    decomposed = table("la", "amo", [form("amās", "second-person singular present indicative active")])
    assert decomposed["la_indic_pres_active"][1] == "amās"


def test_finnish_slang_and_impersonal(table):
    tags = "first-person singular present indicative"
    forms = [form("fi-conj-x", "inflection-template"), form("puhun", tags), form("x", "table-tags"), form("fi-conj-y-slang", "inflection-template"), form("puhuun", tags), form("", "table-tags"), form("puhum", tags)]
    assert table("fi", "puhua", forms)["fi_indic_pres"][0] == "puhun/puhum"
    finite = [form("täydyn", tags), form("täytyy", "third-person singular present indicative"), form("täytyä", "infinitive infinitive-i")]
    impersonal = [{"glosses": ["must"], "tags": ["impersonal"]}, {"glosses": ["old"], "tags": ["dated"]}]
    assert table("fi", "täytyä", finite, senses=impersonal)["fi_indic_pres"] == ["", "", "täytyy", "", "", "", ""]
    assert table("fi", "täytyä", finite, senses=[*impersonal, {"glosses": ["x"]}])["fi_indic_pres"][0] == "täydyn"
    no = table("fi", "ei", [form("en", "first-person singular indicative"), form("älä", "second-person singular")])
    assert no["fi_indic_pres"][0] == "en" and no["fi_imper_pres"][0] == "älä"


def test_portuguese_labels(table):
    we, infinitive = "first-person plural preterite indicative", form("falar", "infinitive impersonal")
    forms = [form("x", "table-tags"), infinitive, form("falamos", f"{we} Brazil"), form("falámos", we), form("vôo", "first-person singular present indicative"), form("y", "table-tags"), form("falar", "infinitive"), form("tou", "first-person singular present indicative")]
    got = table("pt", "falar", forms)
    assert got["pt_indic_pret"][3] == "falamos (Brazil)/falámos (Portugal)"
    assert got["pt_indic_pres"][0] == "vôo (pre-reform)" and got["pt_impers_inf"] == ["falar"]
    only = table("pt", "abolir", [form("abolir", "infinitive"), form("abulo", "first-person singular present indicative"), form("abole", "third-person singular present indicative")], head_templates=[{"name": "pt-verb", "args": {"1": "x<Portugal only; missing in Brazil>"}}])
    assert only["pt_indic_pres"] == ["abulo (Portugal)", "", "abole", "", "", ""]
    rain = table("pt", "chover", [form("chover", "infinitive"), form("chovo", "first-person singular present indicative"), form("chove", "third-person singular present indicative")])
    assert rain["pt_indic_pres"][:3] == ["chovo (figurative)", "", "chove"]
    assert table("pt", "falar", [form("falo", "first-person singular present indicative")]) is None


def test_catalan_past(table):
    past = "preterite indicative third-person"
    got = table("ca", "caldre", [form("caldre", "infinitive"), form("calgué", f"{past} singular"), form("calgueren", f"{past} plural")])
    assert got["ca_indic_periphrastic"] == ["", "", "va caldre", "", "", "van caldre/varen caldre"]
    assert got["ca_indic_pret"][2] == "calgué"
    assert table("ca", "test", [form("testà", f"{past} singular")]) is None
    renamed = [form("ca-conj", "inflection-template", "declension"), form("cantar", "infinitive", "declension"), form("canto", "first-person singular present indicative", "declension")]
    assert table("ca", "cantar", renamed)["ca_indic_pres"][0] == "canto"
    cooking = [form("coure", "infinitive"), form("cuit", "participle past masculine singular"), form("x", "table-tags"), form("coure", "infinitive"), form("cogut", "participle past masculine singular")]
    assert table("ca", "coure", cooking)["ca_impers_partic"] == ["cuit (cooking)/cogut (stinging)"]


def test_dutch_and_swedish_tables(table):
    past = "past first-person singular"
    dutch = [form("a", "table-tags"), form("werkte", past), form("b", "table-tags"), form("wrocht", past)]
    assert table("nl", "werken", dutch)["nl_indic_past"][0] == "werkte"
    own = "active indicative past"
    swedish = [form("dated", "table-tags"), form("hade", own), form("läs", "active indicative present"), form("", "table-tags"), form("hade", own)]
    got = table("sv", "ha", swedish)
    assert got["sv_active_past"] == ["hade"] and got["sv_active_pres"] == ["[läs]"]
    noted = table("sv", "läsa", [form("", "table-tags"), form("las", own)], inflection_templates=[{"name": "sv-conj-st", "args": {"note": "Older strong; obsolete"}}])
    assert noted["sv_active_past"] == ["[las]"]
    assert table("sv", "gå", [form("gack", "active imperative")]) is None


def test_first_tables_auxiliaries_and_limits(table):
    we = "present indicative first-person singular"
    french = [form("vais", we), form("x", "table-tags"), form("vas", we), form("y", "table-tags"), form("non", we), form("allé", "participle past")]
    got = table("fr", "aller", french)
    assert got["fr_indic_pres"][0] == "vais/vas" and "fr_indic_pluperf" in got
    assert table("fr", "aller", [form("allé", "participle past")])["fr_indic_pres_perf"] == ["ai allé", "as allé", "a allé", "avons allé", "avez allé", "ont allé"]
    english = table("en", "go", [form("go", "infinitive"), form("gone", "participle past"), form("went", "participle past"), form("go", "plural present"), form("goes", "plural present")])
    assert english["en_impers_past_partic"] == ["gone"] and english["en_indic_pres"] == ["", "", "", "go", "go", "go"]
    assert table("fr", "aller", []) is None and table("fr", "aller", [form("x y", we)]) is None


def test_metadata():
    for code in paradigms.LINES:
        found = paradigms.metadata(code)
        assert len(found["tenseNames"]) == len(set(found["tenseNames"])) == len(found["tensePronouns"])
        assert sorted(i for g in found["tenseGroups"] for i in g["tenseIndices"]) == list(range(len(found["tenseNames"])))
    assert [len(paradigms.tenses(c)) for c in ("el", "la", "fi", "sv")] == [21, 37, 21, 20]
    assert paradigms.metadata("es")["tensePronouns"][-1] == ["tú", "usted", "nosotros/-as", "vosotros/-as", "ustedes"]
