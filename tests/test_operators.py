"""Operators on small tables written by hand."""

import gzip
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexloom import catalogue
from lexloom.functions import text
from lexloom.functions.display import abbreviated
from lexloom.operators import dedup, forms, links
from lexloom.plans import lexicon
from lexloom.sources import jsonl, sinks


def test_dense_ids_follow_frequency_then_name(spark):
    rows = spark.createDataFrame([("x", w, f) for w, f in [("b", 1.0), ("a", 1.0), ("abz", 1.0), ("aba", 1.0), ("c", 2.0)]], "g string, w string, f double")
    got = {r["w"]: r["id"] for r in lexicon.dense_ids(rows, ["g"], "f", "w").collect()}
    assert got == {"c": 0, "a": 1, "aba": 2, "abz": 3, "b": 4}


def test_unsubsumed_drops_strict_subsets_of_the_same_kind(spark):
    rows = spark.createDataFrame([([(["past"], "k"), (["past", "plural"], "k"), (["past"], "other")],)], "r array<struct<g:array<string>,kind:string>>")
    got = rows.select(forms.unsubsumed(F.col("r"), "g", "kind").alias("r")).first()["r"]
    assert [(x["g"], x["kind"]) for x in got] == [(["past", "plural"], "k"), (["past"], "other")]


def test_verified_blocks_take_a_whole_group_or_none(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate("123123")] + [("b", i, s) for i, s in enumerate("123132")], "k string, i int, s string")
    got = forms.verified_blocks(rows, ["k"], "i", "s", [["1", "2", "3"]], 3).groupBy("k").agg(F.bool_and("verified").alias("v")).collect()
    assert {r["k"]: r["v"] for r in got} == {"a": True, "b": False}


def test_tense_cells_keep_order_and_brackets(spark):
    rows = spark.createDataFrame([("v", 1, ["past"], "b"), ("v", 2, ["past", "rare"], "a"), ("v", 3, ["past"], "b"), ("v", 4, ["present"], "c")], "v string, pos int, tags array<string>, form string")
    config = spark.createDataFrame([("p", ["past"], ["none"], ["rare"])], "slot string, wanted array<string>, excluded array<string>, rare array<string>")
    assert forms.tense_matrix(rows, config, ["v"]).first()["cell"] == "b/[a]"


def test_seeded_sample_ignores_partitioning(spark):
    df = spark.range(1000)
    a = {r[0] for r in dedup.seeded_sample(df.repartition(7), "id", 1, 20).collect()}
    assert a == {r[0] for r in dedup.seeded_sample(df.coalesce(1), "id", 1, 20).collect()}


def test_link_targets(spark):
    rows = spark.createDataFrame([("mot#French",), ("Category:x",), ("a" * 201,), ("b",)], "t string")
    got = [r["x"] for r in rows.select(links.link_target(F.col("t"), {"French": "fr"}, F.lit("en")).alias("x")).collect()]
    assert (got[0]["word"], got[0]["lang"]) == ("mot", "fr") and got[1] is None and got[2] is None and got[3]["lang"] == "en"


def test_entries_are_parsed_and_incomplete_ones_set_apart(spark, tmp_path):
    lines = [
        {"pos": "noun", "lang_code": "fr", "lang": "French", "word": "mot", "forms": [{"form": "mots", "tags": ["plural"]}], "unknown": 1},
        {"lang_code": "fr", "lang": "French", "word": "sans"},
        {"source": "thesaurus", "word": "x"},
        {"redirect": "y", "title": "z"},
    ]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("\n\n".join(map(json.dumps, lines)))
    good, bad = jsonl.parse_entries(jsonl.read_lines(spark, str(tmp_path)))
    assert [(r["word"], r["forms"][0]["form"]) for r in good.collect()] == [("mot", "mots")]
    assert [json.loads(r["value"])["word"] for r in bad.collect()] == ["sans"]


def test_split_fails_before_writing_when_a_language_is_empty(spark, tmp_path):
    df = spark.createDataFrame([("fr", 1), ("de", 2)], "lang_code string, x int")
    wanted = spark.createDataFrame([("fr",), ("fi",)], "lang_code string")
    with pytest.raises(ValueError, match="fi"):
        jsonl.split_languages(df, wanted, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_last_write_wins_in_a_chunk(spark):
    df = spark.createDataFrame([("Abc", 1), ("Abc", 2), ("1x", 3), ("?", 4)], "name string, ord int")
    got = {(r["letter"], r["name"], r["ord"]) for r in sinks.letter_chunks(df, "name", "ord").collect()}
    assert got == {("a", "Abc", 2), ("1", "1x", 3), ("_", "?", 4)}


def test_fields_survive_encoding(spark):
    df = spark.createDataFrame([(1, "a" * 5000), (2, "short"), (3, None), (4, "")], "k long, v string")
    packed = sinks.encode_fields(df, "k", "v")
    assert len(next(r["v"] for r in packed.collect() if r["k"] == 1)) < 5000
    assert {r["k"]: r["v"] for r in sinks.decode_fields(packed, "k", "v").collect()} == {1: "a" * 5000, 2: "short", 3: None, 4: ""}


def bare(w):
    return unicodedata.normalize("NFC", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", w)))


def brute_roman(w, mapping):
    """The loose key by one pass of longest matches, before and after the marks go."""
    mapped = lambda x: re.sub("|".join(sorted(mapping, key=len, reverse=True)) or "(?!)", lambda m: mapping[m[0]], x)
    strict = w.strip().lower()
    return re.sub("[’'ʼʹʺ]", "", mapped(bare(mapped(strict)))).strip() or strict


def brute_phonetic(w):
    """The Greek key by Python's re, rule by rule."""
    w = bare(w).lower()
    for a, b in (("μπ", "b"), ("ντ", "d"), ("γκ", "g"), ("γγ", "ng"), ("τσ", "ts"), ("τζ", "dz")):
        w = w.replace(a, b)
    w = re.sub("([αε])υ", lambda m: {"α": "a", "ε": "e"}[m[1]] + ("f" if m.end() == len(w) or w[m.end()] in "πτκθσφχξψ" else "v"), w)
    for a, b in (("αι", "e"), ("ει", "i"), ("οι", "i"), ("ου", "U"), ("υι", "i")):
        w = w.replace(a, b)
    w = "".join(dict(zip("ηωυαειοβγδζκλμνπρσςτφ", "ioiaeiovgdzklmnprsstf", strict=True)).get(c, c) for c in w)
    for a, b in (("θ", "th"), ("ξ", "ks"), ("χ", "ch"), ("ψ", "ps"), ("mp", "b"), ("nt", "d"), ("gk", "g"), ("ph", "f")):
        w = w.replace(a, b)
    w = re.sub("c(?!h)", "k", w).replace("q", "k").replace("w", "o").replace("x", "ch")
    w = re.sub("(?<![ctk])h", "ch", w).replace("y", "i")
    w = re.sub("([ae])u", lambda m: m[1] + ("f" if m.end() == len(w) or w[m.end()] in "ptksfc" else "v"), w)
    for a, b in (("ei", "i"), ("ai", "e"), ("oi", "i"), ("ou", "U"), ("u", "i"), ("U", "u")):
        w = w.replace(a, b)
    return w


WORDS = "αυτός αυγό ευχή μπαίνω πούλι ψυχή ντύνω θέλω άγγελος κήπος ξένος psihi chronos quick wax yoghurt auto augo efharisto eucharist au house abc123 łódź śiva kṣatriya"


def folder(tmp_path, spark, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_keys_of_all_words(spark, tmp_path):
    sf = folder(tmp_path, spark, [(1, WORDS, "el", "a", 9), (2, WORDS, "en", "a", 9)])
    got = {r["w"]: r["key"] for r in catalogue.QUERIES["phonetic_words"](spark, sf).collect()}
    assert got == {w: brute_phonetic(w) for w in WORDS.split()}
    rows = catalogue.QUERIES["romanization_words"](spark, sf).collect()
    assert len(rows) == len(WORDS.split()) * len(text.ROMANIZATION)
    assert {(r["w"], r["profile"]): r["key"] for r in rows} == {(w, p): brute_roman(w, m) for w in WORDS.split() for p, m in text.ROMANIZATION.items()}


def test_queries_without_a_cap_take_all(spark, tmp_path):
    stems = [f"intern{c}" for c in "abcdefghijkl"]
    late = "The one the two, other THE then bathe " + " ".join(stems) + " zebra"
    sf = folder(tmp_path, spark, [(1, late, "en", "a", 9), (2, "un deux trois quatre cinq zebra", "fr", "a", 9), (3, None, "fr", "a", None), (4, "", "fr", "a", 0)])
    spark.createDataFrame([(1, k, "user" if k % 2 else "bot", f"{k}x") for k in range(7)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, sf).collect()
    want = sorted((1, m.start(), m.end()) for m in re.finditer("the", late.lower()))
    assert len(want) > 5 and sorted((r["doc_id"], r["start"], r["stop"]) for r in run("emphasis_places")) == want
    assert {(r["role"], r["tags"], r["turn"]) for r in run("merged_turn_tags")} == {("bot", "0,2,4,6", 0), ("user", "1,3,5", 1)}
    got = {(r["lang"], r["word"]): r["verified"] for r in run("verified_links")}
    assert {w for (lang, w), ok in got.items() if lang == "fr" and ok} == {"zebra"} and len([1 for lang, _ in got if lang == "fr"]) == 6
    assert all(got["en", w] for w in stems)
    shown = {r["stem"]: r["shown"] for r in run("abbreviate_variants")}
    assert shown == {"intern": abbreviated(stems)}


def test_sitemap_pages_number_names_over_blocks(spark):
    words = ["a", "ab", "abcd", "abcde", "abcdf", "b", "zz", "é", "𐍈"]
    rows = [(lang, w) for lang in ("x", None) for w in words for _ in range(2)] + [("x", None)]
    got = sinks.sitemap_pages(spark.createDataFrame(rows, "lang string, w string"), "lang", "w", "u", 2).collect()
    assert sorted(r["page"] for r in got if r["lang"] is None) == [k // 2 for k in range(9)]
    pages = {r["url"]: r["page"] for r in got if r["url"] is not None}
    # The null name stands first.
    assert [pages[f"u/x/{w}"] for w in words[:7]] == [(k + 1) // 2 for k in range(7)]
    assert sinks.sitemap_pages(spark.createDataFrame([], "lang string, w string"), "lang", "w", "u").count() == 0
