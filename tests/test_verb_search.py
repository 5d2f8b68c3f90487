"""Native matches against plain Python, and the order of languages."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lexloom.operators import verb_search as vs

VERBS = [
    (1, "de", "biegen", 3.0, ["biege", "hat gebogen", "gebogen haben worden sein", None, ""]),
    (2, "pt", "pôr", 4.0, ["ponho/[pus (Brazil)]", "pondes"]),
    (3, "fr", "aller", 5.0, ["vais", "allé", "ai allé"]),
    (4, "fr", "élever", 2.0, None),
    (5, "pt", "por", 1.0, ["por"]),
    (6, "de", "x", 1.0, []),
]
QUERIES = [("gebogen", "de"), ("por", "pt"), ("pus", "pt"), ("alle", "fr"), ("el", "fr"), ("e", "fr"), ("ge", "de"), ("", "fr"), (None, "fr"), ("zzz", "fr"), ("worden", "de"), ("hat", "de")]


def bare(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def forms(verb):
    import re

    out = [verb[2]]
    for cell in verb[4] or []:
        if not cell:
            continue
        if verb[1] in vs.EXPANDED:
            out += [re.sub(r"^[(\[{]+|[)\]}]+$", "", re.sub(r"\s+\([^()]+\)(?=[\]}]*$)", "", v)) for v in cell.split("/")]
        else:
            words = cell.split(" ")
            out.append(words[-2] if len(words) >= 3 and words[-1] in vs.AUXILIARIES else words[-1])
    return list(dict.fromkeys(out))


def brute(q, lang):
    found = []
    for v in VERBS:
        for f in forms(v) if v[1] == lang and q else []:
            quality = 0 if q in f.lower() else 1 if bare(q) in bare(f).lower() else None
            if quality is not None:
                surface = (0 if f.lower() == q else 1 if bare(f.lower()) == bare(q) else 2) if lang in vs.EXPANDED else 0
                found.append((surface, quality, -v[3], len(f), v[0], f))
    return [(x[4], x[5], x[1]) for x in sorted(found)]


def test_native_matches_are_those_of_plain_python(spark):
    verbs = spark.createDataFrame(VERBS, "verb long, lang string, name string, freq double, cells array<string>")
    queries = spark.createDataFrame(QUERIES, "q string, lang string")
    rows = vs.ranked_matches(vs.native_matches(verbs, queries)).orderBy("q", "lang", "rank").collect()
    for q, lang in QUERIES:
        assert [(r.verb, r.matched, r.quality) for r in rows if (r.q, r.lang) == (q, lang)] == brute(q, lang)


def test_greek_sounds_and_whole_words(spark):
    verbs = spark.createDataFrame([(1, "el", "βοηθώ", 1.0, ["να βοηθήσω"]), (2, "fr", "se lever", 1.0, None)], "verb long, lang string, name string, freq double, cells array<string>")
    sounds = vs.native_matches(verbs, spark.createDataFrame([("βοιθο", "el")], "q string, lang string")).collect()
    assert [(r.verb, r.quality) for r in sounds if r.matched == "βοηθώ"] == [(1, 2)]
    asked = spark.createDataFrame([("lev", "fr"), ("lever", "fr")], "q string, lang string")
    assert [r.q for r in vs.native_matches(verbs, asked, whole_word=True).collect()] == ["lever"]


def test_language_order(spark):
    rows = [("el", "ελληνικά"), ("en", "English"), ("fr", "français"), ("ar", "العربية"), ("cs", "čeština"), ("da", "dansk"), ("zh", "中文"), ("es", "español"), ("b", "same"), ("a", "SAME")]
    got = vs.language_order(spark.createDataFrame(rows, "code string, name string")).orderBy("place").collect()
    assert [r.code for r in got] == ["ar", "cs", "da", "el", "en", "es", "fr", "a", "b", "zh"]
