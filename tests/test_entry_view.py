"""Labels, groups, links and filters of entries, and point reads, on rows written by hand."""

from pyspark.sql import functions as F

from lexloom.functions import entry_view
from lexloom.operators import point_reads

DETAILS = "array<struct<form:string,kind:string,tags:array<string>,readings:array<struct<grammar:array<string>,qualifiers:array<string>>>>>"


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first().asDict(recursive=True).values()


def test_labels_and_sounds(spark):
    got = one(spark, "a string, b string, c string", ("North-Wales", "Vivaro-Alpine", "1ˢᵗ–4ᵗʰ"), entry_view.usage_label(F.col("a")), entry_view.usage_label(F.col("b")), entry_view.pronunciation_label(F.col("c")))
    assert list(got) == ["North Wales", "Vivaro-Alpine", "1st–4th"]
    sounds = "l array<struct<ipa:string,label:string>>, s string"
    shown = entry_view.shown_pronunciations(F.col("l"), F.col("s"))
    both = [{"ipa": "/x/", "label": "a"}, {"ipa": "/x/", "label": "b"}]
    assert list(one(spark, sounds, ([("/x/", "a"), ("/x/", "b")], "/y/"), shown)) == [both]
    assert list(one(spark, sounds, ([], "/y/"), shown)) == [[{"ipa": "/y/", "label": None}]]
    assert list(one(spark, sounds, (None, None), shown)) == [[]]


def test_form_readings_and_groups(spark):
    third = (["third-person", "singular"], None)
    details = [
        ("lenne", "inflection", None, [(["second-person"], ["formal", "North-Wales"]), third, third]), ("b", "variant", ["archaic", "North-Wales"], None),
        ("b", "related", ["archaic", "literary"], [([], [])]), ("c", None, None, None), (None, None, ["x"], None),
    ]
    row = (details, ["c", "lenne", "b", "unlisted", None])
    readings, groups = one(spark, f"d {DETAILS}, f array<string>", row, entry_view.form_readings(F.col("d")), entry_view.form_groups(F.col("d"), F.col("f")))
    assert [(r["form"], r["labels"], r["readings"]) for r in readings] == [
        ("lenne", "", ["second person · formal, North Wales", "third person singular"]), ("b", "archaic, North Wales, literary", ["archaic, North Wales, literary"]),
        ("c", "", []), (None, "x", ["x"]),
    ]
    assert [(g["label"], g["forms"]) for g in groups] == [("Inflections", ["lenne"]), ("Related formations", ["b"]), ("Other forms", ["c", "unlisted", None])]
    assert list(one(spark, f"d {DETAILS}, f array<string>", (None, None), entry_view.form_readings(F.col("d")), entry_view.form_groups(F.col("d"), F.col("f")))) == [[], []]


def test_links_and_filters(spark):
    rows = [("a b", "en", None, True, "a b"), ("*a", "en", None, True, ""), ("w:a", "en", None, True, None), ("a", "en", "family", True, None), ("a", "en", "language", None, "Éa!'()*~+")]
    df = spark.createDataFrame(rows, "w string, c string, k string, i boolean, a string")
    got = df.select(entry_view.local_language(F.col("w"), F.col("c"), F.col("k"), F.col("i")).alias("l"), entry_view.external_url("x/", F.col("w"), F.col("a"), F.lit("S")).alias("u")).collect()
    assert [(r["l"], r["u"]) for r in got] == [("en", "x/a%20b#a%20b"), (None, "x/*a#S"), (None, "x/w%3Aa#S"), (None, "x/a#S"), (None, "x/a#%C3%89a!'()*~%2B")]
    typed = spark.createDataFrame([(" FRAN",), ("de",), ("nch fr",), ("xx",), ("",), (None,)], "q string")
    hits = typed.select(entry_view.matches_filter(F.col("q"), F.lit("Français"), F.lit("French"), F.lit("fr")).alias("h")).collect()
    assert [r["h"] for r in hits] == [True, False, True, False, True, True]


def test_point_reads(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    records = "lang string, name string, record string"
    asked = table([("fr", "Mot"), ("fr", "mot"), ("fr", "loin"), ("fr", "rien"), ("xx", "mot"), (None, "mot"), ("fr", None)], "lang string, name string")
    chunks = table([("fr", "mot", "old", "m"), ("fr", "loin", "far", "l"), ("fr", "rien", "wrong chunk", "x")], records + ", letter string")
    got = {(r["lang"], r["name"]): (r["place"], r["record"]) for r in point_reads.record_cascade(asked, table([("fr", "mot", "new")], records), chunks).collect()}
    nowhere = (None, None)
    assert got == {("fr", "mot"): ("installed", "new"), ("fr", "loin"): ("chunk", "far"), ("fr", "rien"): nowhere, ("xx", "mot"): nowhere, (None, "mot"): nowhere, ("fr", None): nowhere}
    rows = table([(1, "b"), (2, "a"), (2, "c"), (None, "d")], "version int, name string")
    assert [r["name"] for r in point_reads.first_names(rows, F.col("version") == 2, ["name"], 1).collect()] == ["a"]
    assert sorted(r["name"] for r in point_reads.by_ids(rows, table([(2,), (2,), (None,)], "version int"), "version").collect()) == ["a", "c"]
    readers = table([("u", "de"), ("v", "fr"), ("w", None)], "reader string, lang string")
    chosen = lambda have: {r["reader"]: r["lang"] for r in point_reads.chosen_language(readers, table(have, "lang string, place int"), "place").collect()}
    assert chosen([("fr", 2), ("el", 1)]) == {"u": "el", "v": "fr", "w": "el"} and chosen([]) == {"u": None, "v": None, "w": None}
    merged = point_reads.merged_config(table([("a", 1)], "code string, x int"), table([("b", 2)], "code string, x int"), "code").collect()
    assert {(r["code"], r["left"] and r["left"]["x"], r["right"] and r["right"]["x"]) for r in merged} == {("a", 1, None), ("b", None, 2)}
    versions = "lang string, entry_count long"
    assert tuple(point_reads.installed_entries(table([("a", 3), ("b", None)], versions)).first()) == (2, 3) and tuple(point_reads.installed_entries(table([], versions)).first()) == (0, 0)
