"""Dictionary records from entries written by hand."""

import json

import pytest

from lexloom.functions import display
from lexloom.operators import dictionary
from lexloom.sources import jsonl

BASE = {"pos": "noun", "lang_code": "fr", "lang": "French", "word": "mot", "senses": [{"glosses": ["word"]}]}


@pytest.fixture
def record(spark):
    def make(**changes):
        lines = spark.createDataFrame([(json.dumps(BASE | changes), "f", 0)], "value string, file string, src_ord long")
        rows = dictionary.records(jsonl.parse_entries(lines)[0]).collect()
        return rows[0].asDict(recursive=True) if rows else None

    return make


def test_whole_record(record):
    got = record(
        senses=[{"glosses": ["Of speech:", "A word."], "tags": ["masculine", "rare", "x"], "raw_glosses": ["(computer science) A word."], "topics": ["computer-science", "sciences"]}, {"glosses": ["{{bad}}"]}],
        forms=[{"form": "mots", "tags": ["plural"]}, {"form": "mots"}, {"form": "x", "tags": ["table-tags"]}],
        sounds=[{"audio": "a"}, {"ipa": "/mo/"}],
        etymology_text="Etymology tree\na\nFrench mot\nFrom Latin.",
        synonyms=[{"word": "parole", "tags": ["rare", "synonym"]}, {"word": "mot"}, {"word": "Category:x"}],
    )
    assert [s["gloss"] for s in got["senses"]] == ["Of speech: A word."]
    assert got["senses"][0]["tags"] == ["rare"] and got["senses"][0]["topics"] == ["computer-science"]
    assert (got["gender"], got["forms"], got["pronunciation"], got["etymology"]) == ("m", ["mots"], "/mo/", "From Latin.")
    assert [(r["word"], r["tags"]) for r in got["synonyms"]] == [("parole", ["rare"])]


@pytest.mark.parametrize("changes", [{"pos": "symbol"}, {"word": ""}, {"categories": ["French multiword forms"]}, {"senses": []}, {"senses": [{"glosses": ["[[x]]"]}]}])
def test_rejected_entries(record, changes):
    assert record(**changes) is None


def test_exceptions_by_language(record):
    assert record(lang_code="zh", lang="Chinese", pos="character")
    assert record(lang_code="nv", lang="Navajo", word="yáʼátʼééh", categories=[{"name": "Navajo terms in nonstandard scripts"}])


def test_gender_from_templates(record):
    assert record(head_templates=[{"name": "h", "args": {"g": "m", "g2": "f"}}])["gender"] == "m-f"
    assert record(pos="verb", head_templates=[{"name": "h", "args": {"g": "m"}}])["gender"] is None


def test_summary_gloss(record):
    got = record(senses=[{"glosses": ["To act", "A; b (note). "]}, {"glosses": ["To act", "skipped"]}, {"glosses": ["Used to form x"]}, {"glosses": ["C [d]; e"]}, {"glosses": ["f"], "form_of": [{"word": "z"}]}])
    assert got["gloss"] == "a; b; c; ..."


@pytest.mark.parametrize("gloss, term, bold", [("a small bird", "small bird", ["small bird"]), ("a small yellow bird", "Small bird", ["small", "bird"]), ("none", "x", [])])
def test_highlight(gloss, term, bold):
    got = display.highlighted(gloss, term)
    assert [x for x, b in got if b] == bold and "".join(x for x, _ in got) == gloss


def test_links_take_the_longest_label_at_word_boundaries():
    assert display.linked("old bookshop book", {"book": "b", "old bookshop": "o"}) == [("old bookshop", "o"), (" ", None), ("book", "b")]


def test_emphasis_ignores_bad_ranges():
    assert display.emphasised("a𐍈c", [(1, 2), (2, 9), (-1, 1)]) == [("a", False), ("𐍈", True), ("c", False)]
