"""Links of etymology templates, by the layout of their arguments."""

import pytest

from lexloom.operators import links

KIND = "array<struct<name:string,args:map<string,string>,expansion:string>>"
ANCHORS = {"Latin": "la", "Old French": "fro"}


@pytest.fixture(scope="module")
def got(spark):
    def run(templates):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(templates,)], f"x {KIND}")
        return [tuple(r) for r in df.select(links.etymology_links(F.col("x"), ANCHORS).alias("y")).first()["y"]]

    return run


def of(name, *args, **named):
    return (name, {str(k + 1): v for k, v in enumerate(args)} | named, None)


def test_layouts(got):
    templates = [
        of("inh", "fr", "la", "aqua", "aquam"),
        of("bor+", "en", "fr", "eau", alt="l'eau"),
        of("cog", "it", "acqua"),
        of("m", "it", "acqua", "acqua"),
        of("compound", "en", "water", "fall", alt2="falls", lang1="ang"),
        of("surf", "+suf", "x", "y"),
        of("other", "en", "z"),
        of("af", "en", "a", "b", "c", "d", "e", "f", "g", "h", "i", "j"),
    ]
    want = [("aqua", "la", None, "aquam"), ("eau", "fr", None, "l'eau"), ("acqua", "it", None, None), ("water", "ang", None, None), ("fall", "en", None, "falls")]
    assert got(templates) == want + [(x, "en", None, None) for x in "abcdefghij"]


def test_words_that_are_no_links(got):
    bad = ["", "-", "?", "*akwa", "w:Water", "a/b", "a<b>", "x" * 201, "#Latin", None]
    assert got([of("m", "la", x) for x in bad] + [of("m", "", "aqua"), ("m", None, None), of("der", "en", "la")]) == []


def test_anchors_and_empty(got):
    assert got([of("l", "en", "aqua#Latin"), of("l", "en", "eve#Old_French"), of("l", "en", "run#Verb"), of("l", "en", "run#Etymology 2")]) == [
        ("aqua", "la", None, None), ("eve", "fro", None, None), ("run", "en", "Verb", None), ("run", "", "Etymology 2", None),
    ]
    assert got([]) == [] and got(None) == []
