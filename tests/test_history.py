"""Recent words and trails, kept and read back."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import history


def test_recent_and_trail(spark):
    rows = [("u", "en", w, t) for t, w in enumerate("abcab")] + [("u", "fr", "a", 4), ("u", "en", "z", None), ("w", "en", "a", 1), (None, "en", "a", 1)]
    views = spark.createDataFrame(rows, "user string, lang string, word string, at int")
    got = history.recent(views, ["user"], ["lang", "word"], "at", 4).orderBy("user", "rank").collect()
    assert [(r["user"], r["lang"], r["word"]) for r in got] == [(None, "en", "a"), ("u", "en", "b"), ("u", "fr", "a"), ("u", "en", "a"), ("u", "en", "c"), ("w", "en", "a")]
    kept = history.trail(views.where("user = 'u' and lang = 'en' and at is not null"), ["user"], ["at"], 3).orderBy("place").collect()
    assert [(r["word"], r["place"]) for r in kept] == [("c", 1), ("a", 2), ("b", 3)]
    assert history.recent(views.limit(0), ["user"], ["word"], "at").count() == 0


@pytest.fixture(scope="module")
def read(spark):
    def values(texts, made):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").select("i", made.alias("v")).orderBy("i").collect()
        return [r.asDict(recursive=True)["v"] for r in rows]

    return values


def test_saved_recent_words(read):
    item = lambda lang="en", word="a", at=1: {"lang": lang, "word": word, "viewedAt": at, "more": 1}
    texts = [
        json.dumps([item(), item("xx"), item(word=""), item(at=None), item(at=2), item(word="b"), None]),
        json.dumps([item(word=str(k)) for k in range(40)]), "{}", "no json", None, "null",
    ]
    got = read(texts, history.valid_recent(F.col("raw"), ["en", "fr"]))
    assert [(x["word"], x["viewedAt"]) for x in got[0]] == [("a", 1.0), ("b", 1.0)]
    assert [x["word"] for x in got[1]] == [str(k) for k in range(30)]
    assert got[2:] == [[], [], [], []]


def test_saved_trails(read):
    page = lambda i="1", url="/a", label="": {"id": i, "url": url, "label": label}
    good = {"entries": [page(), page("2")], "cursor": 1}
    bad = [
        {**good, "cursor": 2}, {**good, "cursor": -1}, {**good, "cursor": 0.5}, {"entries": [page(), page()], "cursor": 0}, {"entries": [page("")], "cursor": 0},
        {"entries": [page(url="//x")], "cursor": 0}, {"entries": [page(url="x")], "cursor": 0}, {"entries": [page(url="/a\\b")], "cursor": 0}, {"entries": [page(label=None)], "cursor": 0},
        {"entries": [page(str(k)) for k in range(101)], "cursor": 0}, {"entries": [], "cursor": 0}, {"cursor": 0}, [], None,
    ]
    got = read([json.dumps(good), *map(json.dumps, bad), "x", None], history.valid_trail(F.col("raw")))
    assert got[0] == {"entries": good["entries"], "cursor": 1.0}
    assert all(x == {"entries": [], "cursor": -1.0} for x in got[1:]), got[1:]
