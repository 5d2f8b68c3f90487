"""Shown segments of forms and texts: variants, markers of register, links and emphasis.

Everything here is a Column expression over one row; a null input gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers of register, and what stands for a letter beside a label.
MARKERS = {"(": "deprecated", "[": "rare", "{": "formal"}
CLOSERS = {")": "(", "]": "[", "}": "{"}
LETTER = r"[\p{L}\p{M}\p{N}]"

_SPACE = r"[\s\p{Z}\x{FEFF}]"
#: A note at the end of a variant, before brackets that close.
_NOTE = rf"{_SPACE}+(\([^()]+\))(?=[\]}}]*\z)"
_SEGMENTS = "array<struct<text:string,markers:array<string>,separator:string>>"
_NONE = "array<string>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _shared_start(a: Column, b: Column) -> Column:
    """How many code points two texts begin with alike."""
    unlike = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(unlike == 0, F.length(a)).otherwise((unlike - 1).cast("int"))


def _run(n: Column, holds: Callable[[Column], Column]) -> Column:
    """The largest k of at most n whose places 0 to k - 1 all hold."""
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda acc, i: F.when((acc == i) & holds(i), acc + 1).otherwise(acc))


def variants(parts: Column) -> Column:
    """struct(prefix, suffix, items) of an array of variants: what they share is written once.

    Whole words that all begin or end with are factored out. An item is struct(text, more, at, more_at):
    a variant that only adds letters to the item before it is that item's ``more``, the last of several
    in place of those before, and ``more_at`` its place; others drop the shortest shared start of four
    letters or more, unless the first item ends with what is left. One variant stays as it is.
    """
    item = lambda text, more, at, more_at: F.struct(
        text.alias("text"), more.cast("string").alias("more"), at.cast("int").alias("at"), more_at.cast("int").alias("more_at")
    )

    def of_words(rows: Column) -> Column:
        head = _run(F.size(rows[0]), lambda i: F.forall(rows, lambda r: F.coalesce(F.get(r, i) == F.get(rows[0], i), F.lit(False))))
        return _let(head, lambda n: after_head(rows, n))

    def after_head(rows: Column, head: Column) -> Column:
        front = F.when(head > 0, F.concat(F.array_join(F.slice(rows[0], 1, head), " "), F.lit(" "))).otherwise("")
        rest = F.transform(rows, lambda r: F.when(F.size(r) > head, F.slice(r, head + 1, F.size(r))).otherwise(F.array(F.lit(""))))
        return _let(rest, lambda r: after_rest(front, r))

    def after_rest(front: Column, rest: Column) -> Column:
        back = lambda r, i: F.get(r, F.size(r) - 1 - i)
        tail = _run(F.size(rest[0]) - 1, lambda i: F.forall(rest, lambda r: (F.size(r) - 1 - i >= 1) & (back(r, i) == back(rest[0], i))))
        return _let(tail, lambda n: after_tail(front, rest, n))

    def after_tail(front: Column, rest: Column, tail: Column) -> Column:
        end = F.when(tail > 0, F.concat(F.lit(" "), F.array_join(F.slice(rest[0], F.size(rest[0]) - tail + 1, tail), " "))).otherwise("")
        texts = F.transform(rest, lambda r, i: item(F.array_join(F.slice(r, 1, F.size(r) - tail), " "), F.lit(None), i, F.lit(None)))
        empty = F.slice(texts, 1, 0)

        def merge(acc: Column, x: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            adds = x["text"].startswith(last["text"]) & (F.length(x["text"]) > F.length(last["text"]))
            more = F.substr(x["text"], F.length(last["text"]) + 1)
            joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(item(last["text"], more, last["at"], x["at"])))
            return F.when(F.coalesce(adds, F.lit(False)), joined).otherwise(F.array_append(acc, x))

        return _let(F.aggregate(texts, empty, merge), lambda items: shortened(front, end, items))

    def shortened(front: Column, end: Column, items: Column) -> Column:
        first = items[0]["text"]
        starts = F.transform(items, lambda x: _shared_start(first, x["text"]))
        least = F.array_min(F.filter(F.slice(starts, 2, F.size(starts)), lambda n: n >= 4))

        def cut(x: Column, i: Column, n: Column) -> Column:
            left = F.substr(x["text"], n + 1)
            short = (i > 0) & (_shared_start(first, x["text"]) >= 4) & ~first.endswith(left)
            text = F.when(F.coalesce(short, F.lit(False)), F.concat(F.lit("-"), left)).otherwise(x["text"])
            return item(text, x["more"], x["at"], x["more_at"])

        shown = _let(least, lambda n: F.transform(items, lambda x, i: cut(x, i, n)))
        return F.struct(front.alias("prefix"), end.alias("suffix"), shown.alias("items"))

    alone = F.struct(F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.transform(parts, lambda p, i: item(p, F.lit(None), i, F.lit(None))).alias("items"))
    words = F.transform(parts, lambda p: F.split(p, " "))
    return F.when(F.size(parts) < 2, alone).when(F.size(parts) > 1, _let(words, of_words))


def shown_variants(parts: Column) -> Column:
    """Variants as one text: items parted by '/', one that is only an addition put to the one before it."""

    def text(v: Column) -> Column:
        each = F.transform(v["items"], lambda x: F.concat(x["text"], F.when(x["more"].isNotNull(), F.concat(F.lit("("), x["more"], F.lit(")"))).otherwise("")))
        parted = F.transform(each, lambda x, i: F.when((i == 0) | x.startswith("("), x).otherwise(F.concat(F.lit("/"), x)))
        return F.concat(v["prefix"], F.array_join(parted, ""), v["suffix"])

    return _let(variants(parts), text)


def strip_form_markers(form: Column) -> Column:
    """A form without the notes at the ends of its variants and without brackets."""
    return F.regexp_replace(F.regexp_replace(form, rf"{_SPACE}+\([^()]+\)(?=[\]}}]*(?:/|\z))", ""), r"[(\[{}\])]", "")


def _closed(open_marks: Column, closers: Column) -> Column:
    """The open marks that stay open: each closer takes the last of its kind."""

    def close(acc: Column, c: Column) -> Column:
        for closer, opener in CLOSERS.items():
            acc = F.when(c == closer, F.regexp_replace(acc, rf"\{opener}(?=[^\{opener}]*\z)", "")).otherwise(acc)
        return acc

    return F.aggregate(F.filter(F.split(closers, ""), lambda c: c != ""), open_marks, close)


def _markers(open_marks: Column) -> Column:
    names = F.transform(F.filter(F.split(open_marks, ""), lambda c: c != ""), lambda c: F.element_at(F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair]), c))
    return F.array_distinct(names)


def _segment(text: Column, markers: Column, separator: Column) -> Column:
    return F.struct(text.alias("text"), markers.alias("markers"), separator.cast("string").alias("separator"))


def _parsed(form: Column) -> Column:
    """Segments of a form without notes. Marks that are not closed hold for the variants after them."""
    none = F.array().cast(_NONE)
    pieces = F.flatten(F.transform(F.split(form, "/"), lambda s, i: F.transform(F.split(s, " - "), lambda d: F.struct(d.alias("raw"), i.alias("group")))))
    token = "array<struct<text:string,markers:array<string>,group:int>>"
    start = F.struct(F.lit("").alias("open"), F.array().cast(token).alias("tokens"))

    def step(acc: Column, piece: Column) -> Column:
        split = lambda k: F.regexp_extract(piece["raw"], r"(?s)\A([(\[{]*)(.*?)([}\])]*)\z", k)
        marks = F.concat(acc["open"], split(1))
        made = F.struct(split(2).alias("text"), _markers(marks).alias("markers"), piece["group"].alias("group"))
        return F.struct(_closed(marks, split(3)).alias("open"), F.array_append(acc["tokens"], made).alias("tokens"))

    def groups(tokens: Column) -> Column:
        last = F.get(tokens, F.size(tokens) - 1)["group"]
        return F.transform(F.sequence(F.lit(0), last), lambda g: F.filter(tokens, lambda x: x["group"] == g))

    def segments(grouped: Column) -> Column:
        texts = F.transform(grouped, lambda g: F.array_join(F.transform(g, lambda x: x["text"]), " - "))
        return _let(variants(texts), lambda v: of_items(grouped, v))

    def of_items(grouped: Column, v: Column) -> Column:
        def each(x: Column, i: Column) -> Column:
            group = F.get(grouped, x["at"])
            text = F.concat(F.when(i == 0, v["prefix"]).otherwise(""), x["text"])
            first = F.when(i > 0, "/")
            parts = F.when(F.size(group) == 1, F.array(text)).otherwise(F.split(text, " - "))
            shown = F.transform(group, lambda k, j: _segment(F.coalesce(F.get(parts, j), k["text"]), k["markers"], F.when(j > 0, " - ").otherwise(first)))
            more = F.array(_segment(F.concat(F.lit("("), x["more"], F.lit(")")), F.get(grouped, x["more_at"])[0]["markers"], F.lit(None)))
            return F.concat(shown, F.when(x["more"].isNotNull(), more).otherwise(F.array().cast(_SEGMENTS)))

        end = F.when(v["suffix"] != "", F.array(_segment(v["suffix"], none, F.lit(None)))).otherwise(F.array().cast(_SEGMENTS))
        return F.concat(F.flatten(F.transform(v["items"], each)), end)

    marked = _let(F.aggregate(pieces, start, step, lambda acc: acc["tokens"]), lambda tokens: _let(groups(tokens), segments))
    plain = F.array(_segment(shown_variants(F.split(form, "/")), none, F.lit(None)))
    return F.when(form.rlike(r"[(\[{}\])]"), marked).otherwise(plain)


def form_segments(form: Column) -> Column:
    """array<struct<text, markers, separator>> of a stored form.

    ``/`` parts variants and `` - `` alternatives in them; round, square and curly brackets mark what is
    deprecated, rare and formal. A note in round brackets after a variant stays as it is, without
    markers, and then no variant is abbreviated.
    """
    none = F.array().cast(_NONE)

    def peeled(part: Column) -> Column:
        start = F.struct(part.alias("body"), none.alias("notes"))

        def step(acc: Column, _: Column) -> Column:
            less = F.struct(
                F.regexp_replace(acc["body"], _NOTE, "").alias("body"),
                F.concat(F.array(F.regexp_extract(acc["body"], _NOTE, 1)), acc["notes"]).alias("notes"),
            )
            return F.when(acc["body"].rlike(_NOTE), less).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.regexp_count(part, F.lit(r"\("))), start, step)

    def of_part(part: Column, i: Column) -> Column:
        def made(p: Column) -> Column:
            body = F.transform(_parsed(p["body"]), lambda s, j: _segment(s["text"], s["markers"], F.when((i > 0) & (j == 0), "/").otherwise(s["separator"])))
            return F.concat(body, F.transform(p["notes"], lambda n: _segment(F.concat(F.lit(" "), n), none, F.lit(None))))

        return _let(peeled(part), made)

    parts = F.split(form, "/")
    noted = F.flatten(F.transform(parts, of_part))
    return F.when(form.isNull(), None).when(F.exists(parts, lambda p: p.rlike(_NOTE)), noted).otherwise(_parsed(form))


def shown_pronoun(lang: Column, pronoun: Column, form: Column, aspirated: Column) -> Column:
    """The pronoun as it stands before a form: French 'je' loses its vowel before a vowel or a mute h."""
    elided = (lang == "fr") & pronoun.isin("je", "que je") & form.rlike("^[aeiouyéèêëàâîïôûùh]") & ~F.coalesce(aspirated, F.lit(False))
    return F.when(F.coalesce(elided, F.lit(False)), F.regexp_replace(pronoun, "e$", "'")).otherwise(F.concat(pronoun, F.lit(" ")))


def linked_text(text: Column, links: Column, unique_only: bool = False) -> Column:
    """array<struct<text, link>> of a text: at each place the longest label that begins and ends at borders of words.

    ``links`` is array<struct<word, lang, anchor, label>>. A label with a section mark in it, or none, is
    the word. A label of two different targets stays plain, with ``unique_only`` also one that the text
    holds twice. Languages that begin with '+' are no languages. The labels become one pattern that
    branches by their first characters, so that a place meets the labels of its own character only.
    """
    none = F.array().cast("array<struct<label:string,link:struct<word:string,lang:string,anchor:string>>>")
    shown = lambda x: F.when((x["label"] != "") & ~x["label"].contains("#"), x["label"]).otherwise(x["word"])
    target = lambda x: F.struct(x["word"].alias("word"), x["lang"].alias("lang"), x["anchor"].alias("anchor"))
    usable = F.filter(F.coalesce(links, F.array().cast("array<struct<word:string,lang:string,anchor:string,label:string>>")), lambda x: ~F.coalesce(x["lang"], F.lit("")).startswith("+"))
    named = F.array_distinct(F.transform(usable, lambda x: F.struct(shown(x).alias("label"), target(x).alias("link"))))
    named = F.filter(named, lambda x: x["label"] != "")
    if unique_only:
        named = F.filter(named, lambda x: F.size(F.split(text, _literal(x["label"]))) <= 2)

    def single(rows: Column) -> Column:
        # Sorted by label, a label of several targets has an equal neighbour.
        alike = lambda x, y: F.coalesce(x["label"] == y["label"], F.lit(False))
        return F.filter(rows, lambda x, i: ~alike(x, F.get(rows, i - 1)) & ~alike(x, F.get(rows, i + 1)))

    def of_labels(rows: Column) -> Column:
        labels = F.transform(rows, lambda x: x["label"])
        target_of = F.map_from_arrays(labels, F.transform(rows, lambda x: x["link"]))
        return _let(F.struct(_any_of(labels).alias("pattern"), target_of.alias("targets")), cut)

    def cut(known: Column) -> Column:
        part = lambda s, link: F.struct(s.alias("text"), link.alias("link"))
        found = F.struct(F.split(text, known["pattern"], -1).alias("plain"), F.regexp_extract_all(text, known["pattern"], 0).alias("hits"))

        def woven(x: Column) -> Column:
            hit = lambda i: F.get(x["hits"], i)
            pairs = F.transform(x["plain"], lambda p, i: F.array(part(p, F.lit(None)), part(hit(i), F.try_element_at(known["targets"], F.coalesce(hit(i), F.lit(""))))))
            return F.filter(F.flatten(pairs), lambda y: y["text"] != "")

        return _let(found, woven)

    whole = F.filter(F.array(F.struct(text.alias("text"), F.lit(None).cast("struct<word:string,lang:string,anchor:string>").alias("link"))), lambda y: y["text"] != "")
    made = _let(_let(F.coalesce(F.array_sort(named), none), single), lambda rows: F.when(F.size(rows) > 0, of_labels(rows)).otherwise(whole))
    return F.when(text.isNotNull(), made)


def _literal(c: Column) -> Column:
    """A text as a pattern that matches it alone."""
    return F.regexp_replace(c, r"([!-/:-@\[-`{-~])", r"\\$1")


def _any_of(labels: Column) -> Column:
    """A pattern of labels between borders of words, longest first, that branches by the first character."""
    first = lambda x: F.substring(x, 1, 1)
    order = lambda x: F.struct(first(x).alias("first"), (-F.length(x)).alias("n"), x.alias("label"))

    def branches(rows: Column) -> Column:
        # Sorted rows open a branch where their first character differs from the row's before.
        def each(x: Column, i: Column) -> Column:
            label = x["label"]
            fresh = F.concat(F.when(i > 0, ")|").otherwise(""), _literal(x["first"]), F.lit("(?:"))
            rest = F.concat(_literal(F.substr(label, F.lit(2))), F.when(label.rlike(rf"(?s){LETTER}\z"), rf"(?!{LETTER})").otherwise(""))
            same = F.coalesce(F.get(rows, i - 1)["first"] == x["first"], F.lit(False))
            return F.concat(F.when(same, "|").otherwise(fresh), rest)

        return F.concat(F.array_join(F.transform(rows, each), ""), F.lit("))"))

    def side(letters: bool) -> Column:
        chosen = F.filter(labels, lambda x: first(x).rlike(LETTER) if letters else ~first(x).rlike(LETTER))
        joined = F.concat(F.lit(rf"(?<!{LETTER})(?:" if letters else "(?:"), _let(F.array_sort(F.transform(chosen, order)), branches))
        return F.when(F.exists(labels, lambda x: first(x).rlike(LETTER) if letters else ~first(x).rlike(LETTER)), joined)

    return F.concat_ws("|", side(True), side(False))


def bold_text(text: Column, ranges: Column) -> Column:
    """array<struct<text, bold>> of a text and its array<struct<start, stop>> of code points.

    Ranges outside the text, empty ones and nulls count for nothing; those that touch or overlap are one.
    """
    span = "array<struct<start:int,stop:int>>"
    inside = lambda r: (r["start"] >= 0) & (r["stop"] > r["start"]) & (r["stop"] <= F.length(text))
    good = F.array_sort(F.filter(F.coalesce(ranges.cast(span), F.array().cast(span)), lambda r: F.coalesce(inside(r), F.lit(False))))

    def merge(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], r["stop"]).alias("stop"))
        return F.when(F.coalesce(r["start"] <= last["stop"], F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.array_append(acc, r))

    def parts(x: Column) -> Column:
        runs, points = x["runs"], x["points"]
        piece = lambda a, b, bold: F.struct(F.array_join(F.slice(points, a + 1, b - a), "").alias("text"), F.lit(bold).alias("bold"))
        stop = lambda i: F.coalesce(F.get(runs, i)["stop"], F.lit(0))
        each = F.transform(runs, lambda r, i: F.array(piece(stop(i - 1), r["start"], False), piece(r["start"], r["stop"], True)))
        tail = F.array(piece(stop(F.size(runs) - 1), F.size(points), False))
        return F.filter(F.concat(F.flatten(each), tail), lambda p: p["text"] != "")

    merged = F.aggregate(good, F.array().cast(span), merge)
    return F.when(text.isNotNull(), _let(F.struct(merged.alias("runs"), F.split(text, "").alias("points")), parts))
