"""Text functions by tables of inputs and results, and against the standard library."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.functions.display import abbreviated
from lexloom.operators import index


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word, lang, key", [("IĞDIR", "tr", "ığdır"), ("İZMİR", "az", "izmir"), ("ÉTÉ", "fr", "été"), ("Iris", "en", "iris")])
def test_word_key(spark, word, lang, key):
    assert one(spark, t.word_key(F.col("w"), F.col("l")), w=word, l=lang) == key


@pytest.mark.parametrize("word, lang, key", [("كتاب‌", "fa", "کتاب"), ("كَتَبَ", "ar", "كتب"), ("カタ", "ja", "かた"), ("λόγος", "grc", "λογοσ"), ("été", "fr", "été")])
def test_search_key(spark, word, lang, key):
    assert one(spark, t.search_key(F.col("w"), F.col("l")), w=word, l=lang) == key


@pytest.mark.parametrize("word, key", [("αυτός", "aftos"), ("αυγό", "avgo"), ("ευχή", "efchi"), ("μπαίνω", "beno"), ("πούλι", "puli"), ("ψυχή", "psichi"), ("ντύνω", "dino"), ("θέλω", "thelo"), ("psihi", "psichi")])
def test_greek_key(spark, word, key):
    assert one(spark, t.greek_phonetic(F.col("w")), w=word) == key


@pytest.mark.parametrize("lang, reading, key", [("ru", "ščuka", "shchuka"), ("ka", "ch'ama", "chama"), ("hi", "śakti", "shakti"), ("fa", "xub", "khub"), ("uk", "  žinka ", "zhinka"), ("ru", "jaʹ", "ya")])
def test_romanization_key(spark, lang, reading, key):
    assert one(spark, t.romanization_key(F.col("w"), lang), w=reading) == key


@pytest.mark.parametrize("text, kept", [("  plain ", "plain"), ("a {{b}}", None), ("[[x]]", None), ("Lua error in x", None), ("<br/>", None), ("a < b", "a < b"), ("", None)])
def test_clean_text(spark, text, kept):
    assert one(spark, t.clean_text(F.col("w")), w=text) == kept


def test_strip_diacritics_matches_decomposition(spark):
    base = lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
    letters = [chr(i) for i in range(0xC0, 0x2000) if unicodedata.category(chr(i)).startswith("L") and len(base(chr(i))) == 1]
    rows = spark.createDataFrame([(c,) for c in letters], "w string").select("w", t.strip_diacritics(F.col("w")).alias("x")).collect()
    assert {r["w"]: r["x"] for r in rows} == {c: base(c) for c in letters}


@pytest.mark.parametrize("cell, words", [("habe gemacht/gemacht haben", ["gemacht", "haben"]), ("[alt] (veraltet)", ["alt"]), ("würde gegangen sein", ["gegangen"]), ("-", [])])
def test_index_tokens(spark, cell, words):
    got = one(spark, index.index_tokens(F.col("w")), w=cell)
    assert sorted(set(got)) == sorted(set(words))


@pytest.mark.parametrize("parts, shown", [(["hablo"], "hablo"), (["he hablado", "he dicho"], "he hablado/dicho"), (["andar", "andaré"], "andar(é)"), (["hablara", "hablase"], "hablara/-se"), (["come", "bebe"], "come/bebe")])
def test_abbreviated(parts, shown):
    assert abbreviated(parts) == shown


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=6), min_size=1, max_size=4))
def test_abbreviated_takes_any_parts(parts):
    assert isinstance(abbreviated(parts), str)


def test_gloss_words_leave_out_notes_and_stop_words(spark):
    got = one(spark, index.gloss_words(F.col("w")), w="to make the cake [of flour]; used to form x; ...")
    assert got == ["make", "cake"]


def test_url_quote(spark):
    assert one(spark, t.url_quote(F.col("w")), w="a b*~é") == "a%20b%2A~%C3%A9"


@pytest.mark.parametrize("n, shown", [(10, "10 B"), (2048, "2.0 KB"), (5 * 1024**2, "5.0 MB"), (3 * 1024**3, "3.0 GB")])
def test_byte_size(spark, n, shown):
    assert spark.range(1).select(t.byte_size(F.lit(n)).alias("x")).first()["x"] == shown
