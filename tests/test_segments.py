"""Segments of forms, links and emphasis: cases by hand, and random ones against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import display, segments


@pytest.fixture(scope="module")
def column(spark):
    """The values of an expression over rows."""

    def values(rows, schema, expression):
        made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", expression.alias("v"))
        return [r.asDict(recursive=True)["v"] for r in made.orderBy("i").collect()]

    return values


def seg(text, *markers, sep=None):
    return {"text": text, "markers": list(markers), "separator": sep}


FORMS = {
    "γεννάω": [seg("γεννάω")],
    "mange/manges": [seg("mange(s)")],
    "γεννάνε/γεννάν/γεννούν/γεννούνε": [seg("γεννάνε/-άν/-ούν(ε)")],
    "[{ελέχθην}]": [seg("ελέχθην", "rare", "formal")],
    "ειπώθηκα/λέχθηκα/[{ελέχθην}]": [seg("ειπώθηκα"), seg("λέχθηκα", sep="/"), seg("ελέχθην", "rare", "formal", sep="/")],
    "ευχαριστιόμουν - [ευχαριστούμουν]": [seg("ευχαριστιόμουν"), seg("ευχαριστούμουν", "rare", sep=" - ")],
    "{einer/zwei}/drei": [seg("einer", "formal"), seg("zwei", "formal", sep="/"), seg("drei", sep="/")],
    "γεννάνε/[γεννούνε]": [seg("γεννάνε"), seg("-ούνε", "rare", sep="/")],
    "seist gegangen/{seiest gegangen}": [seg("seist"), seg("seiest", "formal", sep="/"), seg(" gegangen")],
    "γεννάνε/γεννάν/γεννούν/[γεννούνε]": [seg("γεννάνε"), seg("-άν", sep="/"), seg("-ούν", sep="/"), seg("(ε)", "rare")],
    "falámos (Portugal)/falamos (Brazil)": [seg("falámos"), seg(" (Portugal)"), seg("falamos", sep="/"), seg(" (Brazil)")],
    "[form (historical)]": [seg("form", "rare"), seg(" (historical)")],
    "[form (a)] (b)/x - (y)": [seg("form", "rare"), seg(" (a)"), seg(" (b)"), seg("x -", sep="/"), seg(" (y)")],
    "": [seg("")],
    "(((": [seg("", "deprecated")],
    None: None,
}


def test_form_segments(column):
    got = column([(f,) for f in FORMS], "f string", segments.form_segments(F.col("f")))
    assert dict(zip(FORMS, got, strict=True)) == FORMS


def test_strip_markers_and_pronouns(column):
    forms = ["[{ελέχθην}]", "(-ιόσαστε)", "falámos (Portugal)/[falamos (Brazil)]", "a (b) c", "", None]
    assert column([(f,) for f in forms], "f string", segments.strip_form_markers(F.col("f"))) == ["ελέχθην", "-ιόσαστε", "falámos/falamos", "a b c", "", None]
    rows = [("fr", "je", "aime", False), ("fr", "que je", "hésite", None), ("fr", "je", "hurle", True), ("fr", "je", "mange", False), ("it", "je", "amo", False), ("fr", "tu", "aimes", False), (None, "je", "aime", None), ("fr", None, "aime", False)]
    shown = segments.shown_pronoun(F.col("l"), F.col("p"), F.col("f"), F.col("h"))
    assert column(rows, "l string, p string, f string, h boolean", shown) == ["j'", "que j'", "je ", "je ", "je ", "tu ", "je ", None]


def test_variants_equal_plain_python(column):
    rng = random.Random(5)
    word = lambda: rng.choice(["", "sein", "gehen"]) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))
    rows = [[" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 5))] for _ in range(400)]
    rows += [["a", "ab", "abc"], ["werde", "werde sein"], ["x sein", "sein"], ["a", "a"], ["", "b"], ["long" * 500, "long" * 400]]
    got = column([(r,) for r in rows], "v array<string>", segments.shown_variants(F.col("v")))
    for r, shown in zip(rows, got, strict=True):
        assert shown == display.abbreviated(r), r


LINKS = "t string, links array<struct<word:string,lang:string,anchor:string,label:string>>"


def test_linked_text_by_hand(column):
    link = lambda word, label=None, lang="en", anchor=None: (word, lang, anchor, label)
    rows = [
        ("old bookshop book", [link("b", "book"), link("o", "old bookshop")]),
        ("from *a.b (c) + d", [link("a.b"), link("root", "(c)"), link("suf", "d", "+suf")]),
        ("ab a ab", [link("x", "a"), link("y", "a"), link("z", "ab")]),
        ("ab a ab", [link("x", "a"), link("x", "a"), link("q", "#sec")]),
        ("plain", None),
        ("", [link("a")]),
        (None, [link("a")]),
        ("é e 𐍈a 𐍈", [link("e"), link("𐍈")]),
        (r"\E x\Qy", [link(r"\E"), link(r"x\Qy")]),
        ("a b", [(None, None, None, None), link("", "")]),
    ]
    short = F.transform(segments.linked_text(F.col("t"), F.col("links")), lambda p: F.concat_ws("=", p["text"], p["link"]["word"]))
    assert column(rows, LINKS, short) == [
        ["old bookshop=o", " ", "book=b"], ["from *", "a.b=a.b", " ", "(c)=root", " + d"], ["ab=z", " a ", "ab=z"], ["ab ", "a=x", " ab"], ["plain"], [], None,
        ["é ", "e=e", " 𐍈a ", "𐍈=𐍈"], [r"\E=\E", " ", r"x\Qy=x\Qy"], ["a b"],
    ]
    once = F.transform(segments.linked_text(F.col("t"), F.col("links"), unique_only=True), lambda p: p["link"]["word"])
    assert column([("a b a", [link("a"), link("b")])], LINKS, once) == [[None, "b", None]]


def test_linked_text_equals_plain_python(column):
    rng = random.Random(6)
    piece = lambda: rng.choice(["a", "b", "ab", " ", ".", "-", "é", "(", "\n"])
    make = lambda n: "".join(piece() for _ in range(rng.randint(1, n)))
    rows = [(make(40), [(f"w{k}", "en", None, label) for k, label in enumerate({make(3) for _ in range(6)})]) for _ in range(300)]
    got = column(rows, LINKS, F.transform(segments.linked_text(F.col("t"), F.col("links")), lambda p: F.array(p["text"], p["link"]["word"])))
    for (text, links), parts in zip(rows, got, strict=True):
        assert [tuple(p) for p in parts] == display.linked(text, {x[3]: x[0] for x in links}), (text, links)


def test_bold_text_equals_plain_python(column):
    rng = random.Random(7)
    rows = [("".join(rng.choice("aé𐍈 ") for _ in range(rng.randint(0, 12))), [(rng.randint(-1, 12), rng.randint(-1, 13)) for _ in range(rng.randint(0, 4))]) for _ in range(300)]
    rows += [("abc", [(None, 2), (0, None)]), ("abc", None), (None, [(0, 1)])]
    got = column(rows, "t string, r array<struct<start:int,stop:int>>", segments.bold_text(F.col("t"), F.col("r")))
    for (text, ranges), parts in zip(rows, got, strict=True):
        if text is None:
            assert parts is None
            continue
        valid = [r for r in ranges or [] if None not in r]
        assert [(p["text"], p["bold"]) for p in parts] == display.emphasised(text, valid), (text, ranges)
