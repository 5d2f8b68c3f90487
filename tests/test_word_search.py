"""All search stages on entries written by hand."""

import random
import re
import unicodedata

import pytest

from lexloom import catalogue
from lexloom.operators import word_search as s

ENTRIES = [
    # id, lang, word, pos, freq, forms, glosses, romanizations
    (1, "fr", "être", "verb", 7.0, ["suis", "était"], ["to be", "to exist"], None),
    (2, "fr", "être", "noun", 5.0, ["êtres"], ["a being"], None),
    (3, "fr", "suis", "noun", 2.0, None, ["follower"], None),
    (4, "fr", "Étreinte", "noun", 3.0, [], ["hug"], None),
    (5, "fr", "étreindre", "verb", 3.0, None, None, None),
    (6, "fr", "bonhomme", "noun", 4.0, ["bonshommes"], ["Being friendly", None, "man"], None),
    (7, "el", "σπίτι", "noun", 6.0, ["σπίτια"], ["house"], ["spíti"]),
    (8, "el", "σπιτικός", "adj", 4.0, None, ["home-made"], ["spitikós"]),
    (9, "fr", "chemin de fer", "noun", 4.0, None, ["railway"], None),
    (10, "fr", "Fer", "name", 9.0, None, ["a name"], None),
    (11, "fr", "fer", "noun", 5.0, None, ["iron"], None),
    (12, "ja", "カメラ", "noun", 3.0, None, ["camera"], None),
    (13, "hi", "शांति", "noun", 3.0, None, ["peace"], ["śānti"]),
]
SCHEMA = "id long, lang string, word string, pos string, freq double, forms array<string>, glosses array<string>, romanizations array<string>"


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder, entries = str(tmp_path_factory.mktemp("search")), spark.createDataFrame(ENTRIES, SCHEMA)
    texts = [("suis", "fr"), ("etre", "fr"), ("being", "fr"), ("omme", "fr"), ("chemin de f", "fr"), ("chemin fe", "fr"), ("fer", "fr"), ("spiti", "el"), ("σπίτι", "el"), ("suis", "el"), ("かめら", "ja"), ("śānti", "hi"), ("shānti", "hi"), ("shā", "hi"), ("!", "fr"), (None, "fr"), ("suis", "fr")]
    rows = s.search(entries, spark.createDataFrame(texts, "q string, lang string"), folder).collect()
    return {(q, lang): [(r.word, r.quality, r.stage) for r in sorted(rows, key=lambda r: r["rank"]) if (r.q, r.lang) == (q, lang)] for q, lang in {(r.q, r.lang) for r in rows}}


def test_headword_before_inflection(found):
    assert found["suis", "fr"] == [("suis", 0, s.EXACT), ("être", 5, s.INFLECTED)]


def test_word_prefix_without_marks(found):
    # Lower case before upper case, and the more frequent of equals first.
    assert found["etre", "fr"] == [("être", 10, s.WORD), ("étreindre", 10, s.WORD), ("Étreinte", 10, s.WORD)]


def test_gloss_place_ranks_before_frequency(found):
    assert [x[:2] for x in found["being", "fr"]] == [("être", 40), ("bonhomme", 40)]


def test_parts_where_few_words_match(found):
    assert found["omme", "fr"] == [("bonhomme", 50, s.PART)]


def test_every_term_counts_and_a_short_last_one_goes(found):
    assert found["chemin de f", "fr"] == [("chemin de fer", 10, s.WORD)] == found["chemin fe", "fr"]


def test_names_and_capitals_last(found):
    assert [w for w, _, _ in found["fer", "fr"]][:2] == ["fer", "Fer"]


def test_sounds_and_romanised_words(found):
    assert found["σπίτι", "el"][0] == ("σπίτι", 0, s.EXACT)
    assert found["spiti", "el"] == [("σπίτι", 5, s.SOUND), ("σπιτικός", 40, s.SOUND_PREFIX)]


def test_aliases_and_romanised_spellings(found):
    assert found["かめら", "ja"] == [("カメラ", 5, s.ALIAS)]
    assert found["śānti", "hi"] == [("शांति", 5, s.ROMAN)]
    assert found["shānti", "hi"] == [("शांति", 6, s.ROMAN)]
    assert found["shā", "hi"] == [("शांति", 40, s.ROMAN_PREFIX)]


def test_other_languages_and_empty_queries_find_nothing(found):
    assert not {("suis", "el"), ("!", "fr"), (None, "fr")} & set(found)


def test_absent_columns_and_empty_tables(spark, tmp_path):
    bare = spark.createDataFrame([r[:5] for r in ENTRIES], "id long, lang string, word string, pos string, freq double")
    asked = spark.createDataFrame([("fer", "fr")], "q string, lang string")
    assert [r.word for r in s.search(bare, asked, str(tmp_path)).orderBy("rank").collect()] == ["fer", "Fer", "chemin de fer"]
    assert s.search(bare.limit(0), asked, str(tmp_path)).count() == 0
    assert s.search(bare, asked.limit(0), str(tmp_path)).count() == 0


def _plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def _split(text):
    return re.findall(r"[^\W_]+", text)


def _brute(entries, q):
    """The stages one after the other over a dict, as a reader of their table would do them; no sounds or romanised words."""
    key, seen, hits = q.strip().lower(), {}, 0
    spoken, terms = _split(key), _split(_plain(key))
    if not terms:
        return []
    typed = terms[:-1] if len(terms) > 1 and len(terms[-1]) < 2 else terms
    entries = sorted(entries)

    def held(text):
        words = _split(_plain(text))
        return all(x in words for x in typed[:-1]) and any(w.startswith(typed[-1]) for w in words)

    def put(e, quality, stage, adds_only=False):
        k = e[2], e[3]
        if k not in seen or (not adds_only and quality < seen[k][0]):
            seen[k] = (0 if stage == s.WORD and e[2].lower() == key else quality, stage, e)

    for e in entries:
        if e[2].lower() == key:
            put(e, 0, s.EXACT)
    for e in sorted(entries, key=lambda e: (-e[4], e[0])):
        if key in [f.lower() for f in e[5] or []]:
            put(e, 5, s.INFLECTED, True)
    for stage, quality, text in ((s.WORD, 10, lambda e: e[2]), (s.FORMS, 20, lambda e: " ".join(e[5] or [])), (s.GLOSS, 40, lambda e: " ".join(g for g in e[6] or [] if g))):
        rows = [e for e in entries if held(text(e))][:50]
        hits += len(rows) if stage == s.WORD else 0
        for e in rows:
            put(e, quality, stage)
    usable = [x for x in spoken if len(x) >= 3]
    if hits < 5 and usable:
        for e in [e for e in entries if all(x in e[2].lower() for x in usable)][:50]:
            put(e, 50, s.PART, True)
    words = {}
    for quality, stage, e in seen.values():
        if e[2] not in words or (quality, -e[4]) < (words[e[2]][0], -words[e[2]][2][4]):
            words[e[2]] = (quality, stage, e)
    place = lambda e: next((i for i, g in enumerate(x for x in e[6] or [] if x) if key in g.lower()), s.NO_GLOSS)
    order = lambda x: (x[0], place(x[2]) if x[0] == 40 else 0, x[2][3] == "name", x[2][2][0] != x[2][2][0].lower(), -x[2][4], len(x[2][2]))
    return [(e[2], e[0], quality, stage) for quality, stage, e in sorted(words.values(), key=order)[:50]]


def test_equals_the_stages_one_by_one(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aàbcd") for _ in range(rng.randint(1, 6)))
    texts = lambda n: [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, n))] or None
    entries = [(i, "fr", rng.choice([word(), word().title(), word() + " " + word()]), rng.choice(["noun", "verb", "name"]), float(rng.randint(1, 5)), texts(3), texts(3), None) for i in range(400)]
    queries = {word() for _ in range(40)} | {word() + " " + word() for _ in range(20)} | {"a", "b", "à", "Ab", "ab a", "cd-ab", " abc "} | {e[2] for e in entries[:15]}
    asked = spark.createDataFrame([(q, "fr") for q in sorted(queries)], "q string, lang string")
    rows = s.search(spark.createDataFrame(entries, SCHEMA), asked, str(tmp_path)).orderBy("rank").collect()
    got = {q: [(r.word, r.id, r.quality, r.stage) for r in rows if r.q == q] for q in queries}
    assert {x[3] for found in got.values() for x in found} == {s.EXACT, s.INFLECTED, s.WORD, s.FORMS, s.GLOSS, s.PART}
    for q in sorted(queries):
        assert (q, got[q]) == (q, _brute(entries, q))


def test_composed_and_decomposed_texts_are_equal(spark, tmp_path):
    nfd = lambda x: unicodedata.normalize("NFD", x)
    words = [("fr", "étreindre"), ("vi", "tiếng việt"), ("ko", "한국어"), ("ja", "ガラス"), ("tr", "İğne")]
    entries = [(i, lang, f(w), "noun", 1.0, [f(w)], [f("é")], None) for i, ((lang, w), f) in enumerate([(x, f) for x in words for f in (str, nfd)])]
    asked = [(f(w), lang) for lang, w in words for f in (str, nfd)] + [("ｶﾞﾗｽ", "ja"), ("がらす", "ja")]
    rows = s.search(spark.createDataFrame(entries, SCHEMA), spark.createDataFrame(asked, "q string, lang string"), str(tmp_path)).collect()
    got = {(q, lang): {(r.word, r.quality) for r in rows if (r.q, r.lang) == (q, lang)} for q, lang in asked}
    for lang, w in words:
        assert got[w, lang] == got[nfd(w), lang] == {(w, 0), (nfd(w), 0)}
    assert {w for w, _ in got["ｶﾞﾗｽ", "ja"]} == {w for w, _ in got["がらす", "ja"]} == {"ガラス", nfd("ガラス")}


def test_entries_are_never_broadcast(spark, tmp_path):
    # Files of repeated values are small and their rows are not: only queries may be sent to all tasks.
    entries = spark.createDataFrame(ENTRIES, SCHEMA)
    found = s.search(entries, spark.createDataFrame([("fer", "fr"), ("spiti", "el")], "q string, lang string"), str(tmp_path))

    def sent(node):
        at = node.children().iterator()
        below = [x for child in iter(lambda: at.next() if at.hasNext() else None, None) for x in sent(child)]
        return below + ([node.output().mkString(",")] if node.nodeName().startswith("BroadcastExchange") else [])

    outputs = sent(found._jdf.queryExecution().executedPlan())
    assert outputs and not [x for x in outputs if re.search(r"\bid#", x)]


def test_query_ranks_every_match_of_a_stage(spark, tmp_path):
    # The best word by frequency comes after more than 50 others, by id and by key.
    words = ["bolt", *(f"bolt{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70))]
    parts = [(i, w, "LARGE", float(i)) for i, w in enumerate(words)] + [(i + 100, f"x{w} seen", "SMALL", 900.0 + i) for i, w in enumerate(words)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    found = catalogue.QUERIES["search_all_stages"](spark, str(tmp_path)).orderBy("rank").collect()
    asked = lambda q: [(r.word, r.id, r.quality, r.stage) for r in found if r.q == q]
    best = [(w, i, 10, s.WORD) for i, w in enumerate(words)][:0:-1]
    assert asked("bolt") == [("bolt", 0, 0, s.EXACT), *best[:49]]
    # More words have the form than a stage would keep, all of them at the inflection's quality.
    assert asked("seen") == [(f"x{w}", i + 100, 5, s.INFLECTED) for i, w in enumerate(words)][:20:-1]


def test_stages_without_limits_equal_those_of_a_limit_that_none_reaches(spark, tmp_path):
    entries = spark.createDataFrame(ENTRIES, SCHEMA)
    asked = spark.createDataFrame([("etre", "fr"), ("spiti", "el"), ("omme", "fr"), ("shā", "hi"), ("being", "fr")], "q string, lang string")
    rows = [sorted(map(tuple, s.search(entries, asked, str(tmp_path), most=most).collect())) for most in (s.LIMIT, None)]
    assert rows[0] and rows[0] == rows[1]
