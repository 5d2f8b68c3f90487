"""Examples, references, readings and redirects of entries written by hand."""

import json

import pytest

from lexloom.operators import entry_details
from lexloom.sources import jsonl

BASE = {"pos": "noun", "lang_code": "fr", "lang": "French", "word": "mot", "senses": [{"glosses": ["word"]}]}
ANCHORS = {"Latin": "la", "Old French": "fro"}


def entries(spark, *changes):
    lines = spark.createDataFrame([(json.dumps(BASE | c), "f", i) for i, c in enumerate(changes)], "value string, file string, src_ord long")
    return jsonl.parse_entries(lines)[0]


@pytest.fixture(scope="module")
def records(spark):
    def make(*changes):
        rows = entry_details.detailed_records(entries(spark, *changes), ANCHORS).orderBy("src_ord").collect()
        return [r.asDict(recursive=True) for r in rows]

    return make


def test_examples(records):
    values = [
        {"text": "q one", "type": "quotation", "ref": "1999 (please add the page), A Book"},
        "a plain string",
        {"text": " \tle mot juste ", "type": "example", "english": " the right word", "bold_text_offsets": [[9, 14], [5, 8], [0, 1], [5, 99], [5], ["5", "8"]], "bold_translation_offsets": [[11, 15]]},
        {"text": "le mot juste", "type": "example"},
        {"text": "un '''mot'''", "type": "example"},
        {"text": "x" * 1201, "type": "example"},
        {"text": "{{bad}}", "type": "example"},
        {"text": "two", "translation": "", "english": "Please provide an English translation", "roman": "tu", "ref": "(please specify it)"},
        {"text": "three"},
    ]
    got, none, empty = records({"senses": [{"glosses": ["word"], "examples": values}]}, {}, {"senses": [{"glosses": ["word"], "examples": []}]})
    first, second, third = got["senses"][0]["examples"]
    assert (first["text"], first["translation"], first["quotation"]) == ("le mot juste", "the right word", False)
    assert [tuple(r.values()) for r in first["bold"]] == [(3, 6), (7, 12)]
    assert [tuple(r.values()) for r in first["translation_bold"]] == [(10, 14)]
    assert (second["text"], second["ref"], second["quotation"], second["bold"]) == ("q one", "1999 , A Book", True, [])
    assert (third["text"], third["translation"], third["roman"], third["ref"]) == ("two", None, "tu", None)
    assert none["senses"][0]["examples"] == empty["senses"][0]["examples"] == []


def test_examples_count_code_points(records):
    (got,) = records({"senses": [{"glosses": ["x"], "examples": [{"text": "𐎠𐎡 mot é", "bold_text_offsets": [[3, 6]]}]}]})
    assert got["senses"][0]["examples"][0]["bold"] == [{"start": 3, "stop": 6}]


def shown(sense, field):
    return [tuple(x.values()) for x in sense[field]]


def test_references(records):
    senses = [
        {"glosses": ["plural of ˈmot"], "links": [["plural", "plural"], ["ˈmot", "mot#French"], ["mot", "mot"]], "form_of": [{"word": "ˈmot"}]},
        {"glosses": ["perfective of делать"], "links": [["делать", "делать#Russian"]], "form_of": [{"word": "делать impf"}, {"word": "{{x}}"}]},
        {"glosses": ["other spelling of a"], "links": [["A", "a#Latin"], ["A", "a#Latin"], ["bad", "w:x"], ["c"]], "alt_of": [{"word": "b#Old French"}, {"word": "b#Old French"}]},
        {"glosses": ["{{unclean}}"], "links": [["z", "z"]]},
        {"glosses": ["none"]},
    ]
    (got,) = records({"senses": senses})
    a, b, c, d = got["senses"]
    assert shown(a, "form_of") == [("mot", "fr", "French", "ˈmot")]
    # The link that targets the same word goes; the one to another word stays in English.
    assert shown(a, "links") == [("mot", "fr", "French", "ˈmot"), ("plural", "en", None, None)]
    assert shown(b, "form_of") == shown(b, "links") == [("делать", "fr", "Russian", None)]
    assert shown(c, "alt_of") == [("b", "fro", None, None)] and shown(c, "form_of") == []
    assert shown(c, "links") == [("b", "fro", None, None), ("a", "la", None, "A")]
    assert d["gloss"] == "none" and d["links"] == d["form_of"] == d["alt_of"] == []


def test_both_kinds_of_reference(records):
    sense = {"glosses": ["x"], "links": [["a", "a"], ["b", "b"]], "form_of": [{"word": "b"}], "alt_of": [{"word": "b"}, {"word": "a"}]}
    (got,) = records({"senses": [sense]})
    s = got["senses"][0]
    assert shown(s, "form_of") == [("b", "fr", None, None)]
    assert shown(s, "alt_of") == shown(s, "links") == [("b", "fr", None, None), ("a", "fr", None, None)]


def test_romanizations(records):
    forms = [
        {"form": " slóvo ", "tags": ["romanization"]},
        {"form": "slóvo", "tags": ["transliteration"]},
        {"form": "слово", "roman": "slovo"},
        {"form": "слова", "roman": "slova"},
        {"form": "slovom", "tags": ["romanization"], "source": "declension"},
        {"form": "a/b", "tags": ["romanization"]},
        {"form": "—", "tags": ["romanization"]},
        {"form": "слово", "tags": ["romanization"]},
        {"form": "slоvo", "tags": ["romanization"]},
        {"form": "123", "tags": ["romanization"]},
        {"form": "dʹo", "tags": ["romanization"]},
        {"form": None, "tags": ["romanization"]},
    ]
    ru, fr, bare = records({"lang_code": "ru", "lang": "Russian", "word": "слово", "forms": forms}, {"forms": forms}, {"lang_code": "ru", "lang": "Russian"})
    assert ru["romanizations"] == ["slóvo", "slovo", "dʹo"]
    assert fr["romanizations"] == bare["romanizations"] == []


def test_readings(records):
    got = records(
        {"lang_code": "ar", "lang": "Arabic", "word": "كتاب", "forms": [{"form": "كِتَاب", "tags": ["canonical"]}, {"form": "كَتَبَ", "tags": ["canonical"]}, {"form": "kitāb", "tags": ["romanization"]}, {"form": "kitāb", "tags": ["romanization"]}, {"form": "a\x01b", "tags": ["romanization"]}]},
        {"lang_code": "ja", "lang": "Japanese", "word": "日本日", "forms": [{"form": "日本日", "tags": ["canonical"], "ruby": [["日", "に"], ["本", "ほん"]]}], "sounds": [{"other": "にほん"}, {"other": "abc"}, {"ipa": "/x/"}]},
        {"lang_code": "zh", "lang": "Chinese", "word": "書", "sounds": [{"zh_pron": "shū", "tags": ["Mandarin", "Pinyin"]}, {"zh_pron": "syu1"}]},
        {"forms": [{"form": "mo", "tags": ["romanization"]}]},
    )
    texts = [[tuple(x.values()) for x in r["readings"]] for r in got]
    assert texts[0] == [("كِتَاب", "Vocalized spelling"), ("kitāb", "Romanization")]
    assert texts[1] == [("にほん日", "Reading"), ("にほん", "Reading")]
    assert texts[2] == [("shū", "Mandarin, Pinyin"), ("syu1", "Reading")]
    assert texts[3] == []


def test_persian_heads_that_are_trusted(records):
    persian = {"lang_code": "fa", "lang": "Persian", "word": "کتاب", "categories": ["Persian terms in nonstandard scripts"]}
    assert [r["word"] for r in records(persian | {"head_templates": [{"name": "fa-noun", "args": {}}]}, persian)] == ["کتاب"]


def test_soft_redirects(spark):
    of = {"lang_code": "zh", "lang": "Chinese", "pos": "soft-redirect", "word": "书"}
    df = entries(spark, of | {"redirects": ["書", " 書", "书", "[[x]]", "册"]}, of | {"redirects": ["书"]}, of, of | {"lang_code": "ko", "redirects": ["書"]})
    assert [tuple(r) for r in entry_details.soft_redirects(df).collect()] == [(0, "zh", "书", ["書", "册"])]


def test_no_entries(spark):
    assert entry_details.detailed_records(entries(spark, {}).where("false"), ANCHORS).collect() == []


def test_enhanced_records(spark):
    usage = ["rare", "plural-only"]
    sense = {"glosses": ["x"], "tags": ["rare", "Old-Attic", "other", "plural-only"], "raw_tags": ["in \"Homer", "bad [x]"], "examples": [{"text": "Synonyms: a"}, {"text": "b#39; c"}, {"text": "good"}]}
    greek = {"lang_code": "grc", "lang": "Ancient Greek", "word": "λόγος", "senses": [{"glosses": ["{{x}}"]}, sense]}
    made = entries(
        spark,
        greek | {"sounds": [{"ipa": "/a/"}, {"ipa": "/b/", "tags": ["Koine", "zz"], "note": "late"}, {"ipa": "/b/", "tags": ["Koine"], "note": "late"}], "head_templates": [{"name": "grc-noun", "args": {"3": "m,f"}}]},
        greek | {"lang_code": "et", "lang": "Estonian", "sounds": [{"ipa": "/a/"}], "senses": [sense | {"tags": ["masculine"]}]},
        greek | {"lang_code": "nn", "lang": "Norwegian Nynorsk", "forms": [{"form": "x", "tags": ["canonical", "neuter"]}], "head_templates": [{"name": "nn-noun-m1", "args": {}}]},
        {"senses": [sense], "sounds": [{"ipa": "/a/"}, {"ipa": "/b/"}]},
    )
    got = [r.asDict(recursive=True) for r in entry_details.detailed_records(made, ANCHORS, usage).orderBy("src_ord").collect()]
    a, b, c, d = got
    assert a["senses"][0]["tags"] == ["rare", "plural-only", "Old Attic", "plural only", "in Homer"]
    assert [x["text"] for x in a["senses"][0]["examples"]] == ["good"]
    assert (a["pronunciation"], [tuple(x.values()) for x in a["pronunciations"]], a["gender"]) == ("/b/", [("/b/", "late, Koine")], "m-f")
    assert (b["gender"], b["pronunciation"], b["pronunciations"]) == (None, "/a/", [])
    assert c["gender"] == "m-n"
    assert (len(d["senses"][0]["examples"]), d["pronunciation"], d["pronunciations"], d["senses"][0]["tags"][:1]) == (3, "/a/", [], ["rare"])
