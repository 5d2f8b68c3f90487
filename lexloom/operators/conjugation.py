"""Verbs to conjugation tables: repairs of each language's source tables, then cells by tense and person.

A verb's forms are one array, a table's worth; every step is a Column over that array, so a verb never
leaves its row and nothing is shuffled. Forms are (form, tags, source) with sorted, distinct tags; a null
array is an empty one. ``conjugations`` puts the steps together. Tenses are configuration (``paradigms``),
a literal of the plan that one expression walks, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.functions.normal import nfc_each
from lexloom.operators import verbs
from lexloom.operators.dictionary import summary_gloss
from lexloom.plans import paradigms

FORM = "struct<form:string,tags:array<string>,source:string>"
FORMS = f"array<{FORM}>"

# Signs, endings, auxiliaries and spellings of the languages' tables.
SUPERSCRIPTS = "¹²³⁴⁵⁶⁷⁸⁹⁰"
PAIRS_OF_SIGNS = {"(": ")", "[": "]", "{": "}"}
GREEK_ENDINGS = (
    ("ουμε", "ομε"), ("ιέστε", "ιόσαστε"), ("ιούνται", "ιόνται"), ("όμαστε", "ώμεθα"), ("άστε", "άσθε"), ("όμασταν", "όμαστε"), ("όσασταν", "όσαστε"),
    ("ιόμασταν", "ιόμαστε"), ("ούμασταν", "ούμαστε"), ("ιόσασταν", "ιόσαστε"), ("ούσασταν", "ούσαστε"), ("ος", "η"), ("ος", "ο"),
)
GREEK_DOUBLED = r"^\[([α-ωάέήίόύώϊϋΐΰ]+)ούσασταν, \[-ούσαστε\] - \1ιόσασταν, \(-ιόσαστε\)$"
FULL_ENDINGS = (("st", "est"), ("t", "et"))
LATIN_RECIPE = r"^(\p{L}+us) \+ (present|imperfect|future) active (indicative|subjunctive) of sum$"
LATIN_SUM = {
    ("present", "indicative"): "sum es est sumus estis sunt",
    ("imperfect", "indicative"): "eram erās erat erāmus erātis erant",
    ("future", "indicative"): "erō eris erit erimus eritis erunt",
    ("present", "subjunctive"): "sim sīs sit sīmus sītis sint",
    ("imperfect", "subjunctive"): "essem essēs esset essēmus essētis essent",
}
LATIN_TIME = {"present": "perfect", "imperfect": "pluperfect", "future": "perfect"}
LATIN_GENDERS = {"masculine": ("us", "ī"), "feminine": ("a", "ae"), "neuter": ("um", "a")}
LATIN_OLD_SUM = "siem siēs siet siēmus siētis sient fuam fuās fuat fuāmus fuātis fuant escit escunt fūvimus fūvisset".split()
FINNISH_OLD = ("archaic", "obsolete", "dialectal", "dated")
FINNISH_FINITE = ("indicative", "conditional", "potential", "imperative")
FINNISH_NO = {"present": "en et ei emme ette eivät".split(), "imperative": "älä älköön älkäämme älkää älkööt".split()}
CATALAN_PAST = (("vaig",), ("vas", "vares"), ("va",), ("vam", "vàrem"), ("vau", "vàreu"), ("van", "varen"))
REGISTERS = ("archaic", "dated", "obsolete", "rare", "dialectal")
PERSONS, NUMBERS = ("first-person", "second-person", "third-person"), ("singular", "plural")
SIX = [(p, n) for n in NUMBERS for p in PERSONS]


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _all(tags: Column, *values: str) -> Column:
    return F.size(F.array_except(_texts(*values), tags)) == 0


def _any(tags: Column, *values: str) -> Column:
    return F.arrays_overlap(tags, _texts(*values))


def _form(text: Column, tags: Column, source: Column | str = "conjugation") -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    return F.struct(text.cast("string").alias("form"), F.array_sort(F.array_distinct(tags)).alias("tags"), source.alias("source"))


def _tagged(f: Column, *more: str) -> Column:
    return _form(f["form"], F.concat(f["tags"], _texts(*more)), f["source"])


def _none() -> Column:
    return F.array().cast(FORMS)


def _each(forms: Column, of: Callable[[Column], Column]) -> Column:
    """The forms that every form becomes, in order."""
    return F.flatten(F.transform(forms, of))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), 0)


def simple(forms: Column) -> Column:
    """The entry schema's forms as (form, tags, source); null tags and arrays count as empty."""
    made = F.transform(forms, lambda f: _form(f["form"], F.coalesce(f["tags"], _texts()), f["source"]))
    return F.coalesce(made, _none())


# --- brackets ------------------------------------------------------------------------------


def balanced_markers(c: Column) -> Column:
    """(before, bare, after): outer pairs of brackets off, an opening one only with its own closing one."""
    start = F.struct(F.lit("").alias("before"), c.alias("bare"), F.lit("").alias("after"))

    def step(a: Column, _: Column) -> Column:
        s, out = a["bare"], a
        for opens, closes in PAIRS_OF_SIGNS.items():
            inner = F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))
            off = F.struct(F.concat(a["before"], F.lit(opens)).alias("before"), inner.alias("bare"), F.concat(F.lit(closes), a["after"]).alias("after"))
            out = F.when(s.startswith(opens) & s.endswith(closes), off).otherwise(out)
        return out

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), start, step)


def loose_markers(c: Column) -> Column:
    """(before, bare, after): all opening brackets at the start and closing ones at the end off."""
    before = F.regexp_extract(c, r"^[(\[{]*", 0)
    rest = F.substring(c, F.length(before) + 1, F.length(c))
    after = F.regexp_extract(rest, r"[)\]}]*$", 0)
    return F.struct(before.alias("before"), F.substring(rest, F.lit(1), F.length(rest) - F.length(after)).alias("bare"), after.alias("after"))


# --- Greek and German ----------------------------------------------------------------------


def greek_parts(c: Column) -> Column:
    """The spellings that one text of a Greek table states; abbreviated endings among its parts go."""

    def expanded(part: Column) -> Column:
        def of(m: Column) -> Column:
            subs = F.transform(F.split(m["bare"], ", "), lambda x: F.trim(x))
            kept = F.filter(subs, lambda x: ~balanced_markers(x)["bare"].startswith("-"))
            listed = F.transform(kept, lambda x: F.concat(m["before"], x, m["after"]))
            whole = F.when(m["bare"].contains(", ") & (m["before"] != ""), listed).otherwise(F.array(part))
            return F.when(m["bare"].startswith("-"), _texts()).otherwise(whole)

        return bound(balanced_markers(part), of)

    bare = F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))
    parts = F.filter(F.transform(F.split(bare, " - "), lambda p: F.trim(p)), lambda p: ~p.isin("—", ""))
    return F.flatten(F.transform(parts, expanded))


def greek_forms(forms: Column) -> Column:
    """Greek source forms, one spelling each, before the common filter."""

    def of(f: Column) -> Column:
        text = F.translate(F.replace(f["form"], F.lit("‑"), F.lit("-")), SUPERSCRIPTS, "")
        stem = F.regexp_extract(text, GREEK_DOUBLED, 1)
        doubled = F.array(*[F.concat(F.lit(a), stem, F.lit(b)) for a, b in (("[", "ούσασταν]"), ("[", "ούσαστε]"), ("", "ιόσασταν"), ("(", "ιόσαστε)"))])
        odd = (stem != "") & _all(f["tags"], "imperfect", "plural", "second-person")
        made = F.transform(F.when(odd, doubled).otherwise(greek_parts(text)), lambda x: _form(x, f["tags"], f["source"]))
        return F.when(f["form"].isNull(), F.array(f)).otherwise(made)

    return _each(forms, of)


def greek_cell(cell: Column) -> Column:
    """A cell's spellings with abbreviated endings written out from the nearest earlier spelling they fit."""

    def repaired(done: Column, form: Column) -> Column:
        def of(m: Column) -> Column:
            word = F.regexp_extract(m["bare"], r"(?s)^(.* )-", 1)
            ending = F.substring(m["bare"], F.length(word) + 1, F.length(m["bare"]))
            bases = F.transform(F.reverse(done), lambda b: loose_markers(b)["bare"])
            bases = F.transform(F.filter(bases, lambda b: b.startswith(word)), lambda b: F.substring(b, F.length(word) + 1, F.length(b)))
            endings = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in GREEK_ENDINGS])

            def written(bases: Column) -> Column:
                fits = F.filter(endings, lambda e: F.concat(F.lit("-"), e["new"]) == ending)
                stems = lambda e: F.transform(F.filter(bases, lambda b: b.endswith(e["old"])), lambda b: F.substring(b, F.lit(1), F.length(b) - F.length(e["old"])))
                return F.flatten(F.transform(fits, lambda e: F.transform(stems(e), lambda b: F.concat(m["before"], word, b, e["new"], m["after"]))))

            return F.coalesce(F.get(bound(bases, written), 0), form)

        # Most spellings state no abbreviated ending, and need no look back.
        return F.when(form.contains("-"), bound(loose_markers(form), of)).otherwise(form)

    return F.aggregate(cell, _texts(), lambda done, form: F.array_append(done, F.when(F.size(done) > 0, repaired(done, form)).otherwise(form)))


def german_cell(cell: Column) -> Column:
    """Of two spellings that differ in a full ending alone, the common one, then the formal one in braces."""
    a, b = F.get(cell, 0), F.get(cell, 1)
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    differ = F.filter(F.zip_with(words(a), words(b), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: ~p["x"].eqNullSafe(p["y"]))

    def of(differ: Column) -> Column:
        x, y = F.get(differ, 0)["x"], F.get(differ, 0)["y"]
        found = F.lit(None).cast("array<string>")
        for short_end, long_end in reversed(FULL_ENDINGS):
            for short, long, common, formal in ((y, x, b, a), (x, y, a, b)):
                stem = F.substring(short, F.lit(1), F.length(short) - len(short_end))
                fits = short.endswith(short_end) & (stem != "") & (F.concat(stem, F.lit(long_end)) == long)
                found = F.when(fits, F.array(common, F.concat(F.lit("{"), formal, F.lit("}")))).otherwise(found)
        return F.when(F.size(differ) == 1, found)

    two = (F.size(cell) == 2) & (F.size(words(a)) == F.size(words(b)))
    return F.when(two, F.coalesce(bound(differ, of), cell)).otherwise(cell)


# --- Latin ---------------------------------------------------------------------------------


def _latin_rows() -> tuple[Column, Column]:
    """Literals: (tense, mood, time, forms) of ``sum``, and (i, person, number, first, ends) of the six persons."""
    auxiliaries = [F.struct(F.lit(t_).alias("tense"), F.lit(m).alias("mood"), F.lit(LATIN_TIME[t_]).alias("time"), _texts(*forms.split()).alias("forms")) for (t_, m), forms in LATIN_SUM.items()]
    people = []
    for i, (person, number) in enumerate(SIX):
        ends = [F.struct(F.lit(gender).alias("gender"), F.lit(e[NUMBERS.index(number)]).alias("end")) for gender, e in LATIN_GENDERS.items()]
        first = LATIN_GENDERS["masculine"][NUMBERS.index(number)]
        people.append(F.struct(F.lit(i).alias("i"), F.lit(person).alias("person"), F.lit(number).alias("number"), F.lit(first).alias("first"), F.array(*ends).alias("ends")))
    return F.array(*auxiliaries), F.array(*people)


def _latin_genders(stem: Column, auxiliary: Column, tags: Column, who: Column) -> Column:
    own = lambda e: F.concat(tags, F.array(who["person"], who["number"], e["gender"], F.lit("multiword-construction")))
    return F.transform(who["ends"], lambda e: _form(F.concat(stem, e["end"], F.lit(" "), auxiliary, F.lit(" ("), e["gender"], F.lit(")")), own(e)))


def _participles(forms: Column) -> Column:
    listed = F.filter(forms, lambda f: (f["source"] == "conjugation") & _all(f["tags"], "perfect", "participle"))
    return F.transform(listed, lambda f: f["form"])


def latin_recipes(forms: Column, participles: Column) -> Column:
    """(form, recipe): each form with the recipe that it states or shares.

    A participle without a recipe takes that of the forms after it, as long as they have the same
    tags and are participles of the entry: a look-ahead that ends with the run of equal tags.
    """

    def of(f: Column, i: Column) -> Column:
        same = lambda x: F.coalesce((x["source"] == "conjugation") & (x["tags"] == f["tags"]), F.lit(False))
        ends = F.filter(F.slice(forms, i + 2, F.size(forms)), lambda x: ~same(x) | x["form"].rlike(LATIN_RECIPE) | ~F.array_contains(participles, x["form"]))
        joined = lambda x: F.concat(f["form"], F.regexp_extract(x["form"], r"^[^+]*( \+ .*)$", 1))
        shared = bound(F.get(ends, 0), lambda x: F.when(same(x) & x["form"].rlike(LATIN_RECIPE) & joined(x).rlike(LATIN_RECIPE), joined(x)))
        own = F.when(f["form"].rlike(LATIN_RECIPE), f["form"])
        open_ = F.array_contains(participles, f["form"]) & f["form"].endswith("us")
        return F.struct(f.alias("f"), F.coalesce(own, F.when(open_, shared)).alias("recipe"))

    return F.transform(forms, of)


def latin_forms(forms: Column, word: Column) -> Column:
    """Latin source forms with recipes and compounds of ``sum`` written out by person and gender; NFC input."""
    auxiliaries, people = _latin_rows()

    def written(f: Column, recipe: Column, tags: Column, participles: Column) -> Column:
        free = (f["source"] == "conjugation") & ~_any(tags, *verbs.METADATA_TAGS)
        said = lambda x: recipe.endswith(F.concat(F.lit(" + "), x["tense"], F.lit(" active "), x["mood"], F.lit(" of sum")))
        timed = lambda x: F.array_contains(tags, x["mood"]) & F.array_contains(tags, x["time"]) & (F.array_contains(tags, "future") == (x["tense"] == "future"))
        barred = lambda p: (_any(tags, *PERSONS) & ~F.array_contains(tags, p["person"])) | (_any(tags, *NUMBERS) & ~F.array_contains(tags, p["number"]))
        stem = F.regexp_extract(recipe, r"^(.*)us \+ ", 1)
        whole = lambda x: F.flatten(F.transform(F.filter(people, lambda p: ~barred(p)), lambda p: _latin_genders(stem, F.get(x["forms"], p["i"]), tags, p)))
        from_recipe = F.flatten(F.transform(F.filter(auxiliaries, lambda x: said(x) & timed(x)), whole))
        parts = F.split(f["form"], r"\s+")
        mood = F.when(F.array_contains(tags, "indicative"), "indicative").when(F.array_contains(tags, "subjunctive"), "subjunctive")
        tense = F.when(F.array_contains(tags, "future"), "future").when(F.array_contains(tags, "pluperfect"), "imperfect").when(F.array_contains(tags, "perfect"), "present")

        def compound(x: Column) -> Column:
            root = lambda p: F.substring(x["first"], F.lit(1), F.length(x["first"]) - F.length(p["first"]))
            known = lambda p: F.exists(auxiliaries, lambda a: (a["tense"] == x["tense"]) & (a["mood"] == x["mood"]) & (F.get(a["forms"], p["i"]) == x["auxiliary"]))
            rare = lambda p: (p["i"] == 5) & (x["auxiliary"] == "erint") & (x["tense"] == "future") & (x["mood"] == "indicative")
            held = lambda p: F.array_contains(tags, p["person"]) & F.array_contains(tags, p["number"]) & x["first"].endswith(p["first"])
            fits = lambda p: F.coalesce(held(p) & F.array_contains(participles, F.concat(root(p), F.lit("us"))) & (known(p) | rare(p)), F.lit(False))
            marked = F.when(x["auxiliary"] == "erint", F.concat(tags, _texts("rare"))).otherwise(tags)
            return F.flatten(F.transform(F.filter(people, fits), lambda p: _latin_genders(root(p), x["auxiliary"], marked, p)))

        pair = F.struct(F.get(parts, 0).alias("first"), F.get(parts, 1).alias("auxiliary"), mood.alias("mood"), tense.alias("tense"))
        found = F.when(free & (F.size(parts) == 2), bound(pair, compound)).otherwise(_none())
        plain = bound(found, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(_form(f["form"], tags, f["source"]))))
        return F.when(free & recipe.isNotNull(), from_recipe).otherwise(plain)

    def with_participles(forms: Column, participles: Column) -> Column:
        def of(pair: Column) -> Column:
            old = (word == "sum") & pair["f"]["form"].isin(*LATIN_OLD_SUM)
            tags = F.when(old, F.array_sort(F.array_distinct(F.concat(pair["f"]["tags"], _texts("archaic"))))).otherwise(pair["f"]["tags"])
            return bound(F.coalesce(tags, _texts()), lambda tags: written(pair["f"], pair["recipe"], tags, participles))

        return _each(latin_recipes(forms, participles), of)

    trimmed = F.transform(forms, lambda f: _form(F.trim(f["form"]), f["tags"], f["source"]))
    return bound(trimmed, lambda forms: bound(_participles(forms), lambda participles: with_participles(forms, participles)))


# --- Finnish -------------------------------------------------------------------------------


def without_flagged(forms: Column, sets: Callable[[Column], Column], clears: Callable[[Column], Column]) -> Column:
    """The forms met while a flag is down: a two-state automaton over the ordered array.

    ``sets`` is null where a form says nothing, else the flag from there on; ``clears`` lowers it first.
    """
    start = F.struct(F.lit(False).alias("up"), _none().alias("kept"))

    def step(a: Column, f: Column) -> Column:
        up = F.coalesce(sets(f), F.when(F.coalesce(clears(f), F.lit(False)), F.lit(False)), a["up"])
        return F.struct(up.alias("up"), F.when(up, a["kept"]).otherwise(F.array_append(a["kept"], f)).alias("kept"))

    return F.aggregate(forms, start, step, lambda a: a["kept"])


def finnish_forms(forms: Column, word: Column, senses: Column) -> Column:
    """Finnish source forms without slang tables; persons of impersonal verbs go, the negative verb's tags are set. NFC input."""
    forms = F.transform(forms, lambda f: _form(F.trim(F.coalesce(f["form"], F.lit(""))), f["tags"], f["source"]))
    template = lambda f: F.when(F.array_contains(f["tags"], "inflection-template"), f["form"].startswith("fi-conj-") & f["form"].endswith("-slang"))
    forms = without_flagged(forms, template, lambda f: F.array_contains(f["tags"], "table-tags"))
    tags_of = lambda s: F.coalesce(s["tags"], _texts())
    modern = F.filter(senses, lambda s: ~_any(tags_of(s), *FINNISH_OLD))
    impersonal = (F.coalesce(F.size(modern), F.lit(0)) > 0) & F.forall(modern, lambda s: F.array_contains(tags_of(s), "impersonal"))
    fits = lambda f: ~_any(f["tags"], *FINNISH_FINITE) | (_all(f["tags"], "third-person", "singular") & ~F.array_contains(f["tags"], "passive"))
    forms = F.filter(forms, lambda f: ~F.coalesce(impersonal, F.lit(False)) | fits(f))

    def repaired(f: Column) -> Column:
        no = (word == "ei") & (f["source"] == "conjugation")
        indicative = F.array_contains(f["tags"], "indicative") & f["form"].isin(*FINNISH_NO["present"])
        orders = f["form"].isin(*FINNISH_NO["imperative"])
        return F.when(no & indicative, _tagged(f, "present")).when(no & orders, _tagged(f, "imperative", "present")).otherwise(f)

    return F.transform(forms, repaired)


# --- Portuguese and Catalan ----------------------------------------------------------------


def tables_of(forms: Column) -> Column:
    """The forms of a verb's inflection tables, one array a table; rows tagged as table open one."""
    inside = F.filter(forms, lambda f: F.coalesce(f["source"].isin("conjugation", "declension", "inflection"), F.lit(False)))
    start = F.struct(F.array().cast(f"array<{FORMS}>").alias("done"), _none().alias("now"))

    def closed(a: Column) -> Column:
        return F.when(F.size(a["now"]) > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"])

    def step(a: Column, f: Column) -> Column:
        opens = F.array_contains(f["tags"], "table-tags")
        return F.when(opens, F.struct(closed(a).alias("done"), _none().alias("now"))).otherwise(F.struct(a["done"].alias("done"), F.array_append(a["now"], f).alias("now")))

    return F.aggregate(inside, start, step, closed)


def own_tables(forms: Column, word: Column, catalan: bool) -> Column:
    """The tables that hold the verb's own infinitive."""
    tables = tables_of(forms)
    if catalan:
        named = lambda x: F.exists(x, lambda f: (f["form"] == "ca-conj") & F.array_contains(f["tags"], "inflection-template"))
        tables = F.transform(tables, lambda x: F.when(F.coalesce(named(x), F.lit(False)), F.transform(x, lambda f: _form(f["form"], f["tags"]))).otherwise(x))
    own = lambda f: (f["source"] == "conjugation") & F.array_contains(f["tags"], "infinitive") & (f["form"] == word)
    return F.filter(tables, lambda x: F.coalesce(F.exists(x, own), F.lit(False)))


def portuguese_forms(forms: Column, word: Column, heads: Column) -> Column:
    """The first table's forms with the region, spelling and use that restrict them in brackets."""
    limited = F.coalesce(F.exists(heads, lambda h: F.exists(F.map_values(h["args"]), lambda v: v.contains("Portugal only; missing in Brazil"))), F.lit(False))
    we = ("first-person", "plural", "preterite", "indicative")

    def labelled(table: Column, f: Column) -> Column:
        tags, text = f["tags"], f["form"]
        short = F.concat(F.substring(text, F.lit(1), F.length(text) - 4), F.lit("amos"))
        paired = F.exists(table, lambda o: (o["form"] == short) & _all(o["tags"], "Brazil", *we))
        present = _all(tags, "present", "indicative", "first-person", "singular") | _all(tags, "present", "subjunctive") | (F.array_contains(tags, "imperative") & ~F.array_contains(tags, "second-person"))
        literal = F.array_contains(tags, "imperative") | (_any(tags, *PERSONS) & ~_all(tags, "third-person", "singular"))
        said = [
            F.when(F.array_contains(tags, "Brazil"), "Brazil"),
            F.when(F.array_contains(tags, "Portugal"), "Portugal"),
            F.when(_all(tags, *we) & text.endswith("ámos") & F.coalesce(paired, F.lit(False)), "Portugal"),
            F.when(present & limited, "Portugal"),
            F.when(text.rlike("[gq][üú][ei]|ôo|êem$"), "pre-reform"),
            F.when((word == "chover") & literal, "figurative"),
        ]
        labels = F.array_distinct(F.filter(F.array(*said), lambda x: x.isNotNull()))
        shown = F.when(F.size(labels) > 0, F.concat(text, F.lit(" ("), F.array_join(labels, ", "), F.lit(")"))).otherwise(text)
        return _form(shown, tags, f["source"])

    kept = lambda table: F.filter(table, lambda f: F.coalesce(f["form"] != "", F.lit(False)))
    first = F.coalesce(F.get(own_tables(forms, word, False), 0), _none())
    return bound(first, lambda table: F.transform(kept(table), lambda f: labelled(table, f)))


def catalan_forms(forms: Column, word: Column) -> Column:
    """The first table's forms, and the past of auxiliary and infinitive for every person that has a preterite."""
    cooking = lambda f: F.array_contains(f["tags"], "participle") & F.coalesce(f["form"].isin("cuit", "cogut"), F.lit(False))
    meaning = lambda f: F.when(f["form"] == "cuit", " (cooking)").otherwise(" (stinging)")
    rains = lambda f: ~_any(f["tags"], "imperative", "first-person", "second-person")
    word_like = lambda f: f["form"].rlike(r"^(?=.*\p{L})(?:[\p{L}·]|\p{L}\p{M})+$")
    people = F.array(*[F.struct(_texts(p, n, "preterite", "indicative").alias("tags"), _texts(*a).alias("auxiliaries")) for (p, n), a in zip(SIX, CATALAN_PAST)])

    def first(tables: Column) -> Column:
        table = F.coalesce(F.get(tables, 0), _none())
        both = F.transform(F.filter(F.flatten(tables), cooking), lambda f: _form(F.concat(f["form"], meaning(f)), f["tags"], f["source"]))
        split = F.concat(F.filter(table, lambda f: ~cooking(f)), both)
        return F.when(word == "coure", split).when(word == "ploure", F.filter(table, rains)).otherwise(table)

    def with_past(table: Column) -> Column:
        infinitives = F.filter(table, lambda f: F.coalesce(F.array_contains(f["tags"], "infinitive") & word_like(f), F.lit(False)))
        there = lambda who: F.exists(table, lambda f: F.coalesce((F.size(F.array_except(who["tags"], f["tags"])) == 0) & verbs.clean_romance(f), F.lit(False)))
        made = lambda who: _each(infinitives, lambda f: F.transform(who["auxiliaries"], lambda a: _form(F.concat(a, F.lit(" "), f["form"]), F.concat(who["tags"], _texts("periphrastic")))))
        return F.concat(table, F.flatten(F.transform(F.filter(people, there), made)))

    return bound(bound(own_tables(forms, word, True), first), with_past)


# --- Dutch and Swedish ---------------------------------------------------------------------


def _opens(f: Column) -> Column:
    return F.coalesce((f["source"] == "conjugation") & F.array_contains(f["tags"], "table-tags"), F.lit(False))


def dutch_forms(forms: Column) -> Column:
    """The forms up to the second table."""
    places = F.filter(F.transform(forms, lambda f, i: F.when(_opens(f), i)), lambda i: i.isNotNull())
    return F.when(F.size(places) > 1, F.slice(forms, F.lit(1), F.get(places, 1))).otherwise(forms)


def swedish_forms(forms: Column, word: Column, templates: Column) -> Column:
    """Cells with the register of their table's heading; of cells alike but for registers the one with fewest, the first of equals."""
    notes = F.filter(F.coalesce(templates, F.array().cast("array<struct<name:string,args:map<string,string>,expansion:string>>")), lambda x: x["name"].startswith("sv-conj"))
    notes = F.transform(notes, lambda x: F.lower(F.coalesce(x["args"]["note"], F.lit(""))))
    aligned = F.size(notes) == F.size(F.filter(forms, _opens))
    known = _texts(*REGISTERS, "nonstandard")

    def registers(f: Column, n: Column) -> Column:
        note = F.when(aligned, F.get(notes, n)).otherwise(F.lit(""))
        heading = F.array_intersect(F.split(F.coalesce(f["form"], F.lit("")), r"\s+"), _texts(*REGISTERS))
        said = F.array_intersect(F.split(note, r"[^\p{L}\p{M}\p{N}_]+"), known)
        return F.array_distinct(F.concat(heading, said, F.when(note.contains("older"), _texts("dated")).otherwise(_texts())))

    start = F.struct(F.lit(-1).alias("n"), _texts().alias("register"), _none().alias("kept"))

    def step(a: Column, f: Column) -> Column:
        n = a["n"] + _opens(f).cast("int")
        register = F.when(_opens(f), registers(f, n)).otherwise(a["register"])
        old = (word == "gå") & (f["form"] == "gack") & F.array_contains(f["tags"], "imperative")
        own = F.concat(f["tags"], register, F.when(F.coalesce(old, F.lit(False)), _texts("archaic")).otherwise(_texts()))
        made = F.when(F.coalesce(f["source"] == "conjugation", F.lit(False)), _form(f["form"], own, f["source"])).otherwise(f)
        return F.struct(n.alias("n"), register.alias("register"), F.array_append(a["kept"], made).alias("kept"))

    basic = lambda f: F.array_except(f["tags"], _texts(*REGISTERS))
    rare = lambda f: F.size(F.array_intersect(f["tags"], _texts(*REGISTERS)))
    alike = lambda f, o: f["form"].eqNullSafe(o["form"]) & (basic(f) == basic(o)) & f["source"].eqNullSafe(o["source"])

    def fewest(marked: Column) -> Column:
        firsts = F.filter(marked, lambda f, i: ~F.exists(F.slice(marked, F.lit(1), i), lambda o: alike(f, o)))
        best = lambda f: F.array_min(F.transform(F.filter(marked, lambda o: alike(f, o)), lambda o, i: F.struct(rare(o).alias("rare"), i.alias("i"), o.alias("o"))))
        return F.transform(firsts, lambda f: best(f)["o"])

    return bound(F.aggregate(forms, start, step, lambda a: a["kept"]), fewest)


# --- cells ---------------------------------------------------------------------------------


def first_tables(forms: Column, n: int) -> Column:
    """The forms before the n-th row that opens a table, such rows left out."""
    opens = lambda f: F.array_contains(f["tags"], "table-tags")
    places = F.filter(F.transform(forms, lambda f, i: F.when(opens(f), i)), lambda i: i.isNotNull())
    cut = F.when(F.size(places) >= n, F.slice(forms, F.lit(1), F.get(places, n - 1))).otherwise(forms)
    return F.filter(cut, lambda f: ~opens(f))


def cells(forms: Column, code: str) -> Column:
    """The cells of all slots of the language's tenses, in order: distinct spellings joined by '/'."""
    slots = F.from_json(F.lit(paradigms.slots_json(code)), paradigms.SLOT)
    barred, rare = _texts(*paradigms.BARRED.get(code, ())), _texts(*paradigms.RARE.get(code, ()))
    usable = F.filter(forms, lambda f: (f["source"] == "conjugation") & ~F.arrays_overlap(f["tags"], barred))
    repair = {"el": greek_cell, "de": german_cell}.get(code, lambda c: c)

    def cell(s: Column) -> Column:
        hits = F.filter(usable, lambda f: (F.size(F.array_except(s["wanted"], f["tags"])) == 0) & ~F.arrays_overlap(s["excluded"], f["tags"]))
        shown = lambda f: F.concat(s["prefix"], f["form"])
        texts = F.array_distinct(F.transform(hits, lambda f: F.when(F.arrays_overlap(f["tags"], rare), F.concat(F.lit("["), shown(f), F.lit("]"))).otherwise(shown(f))))
        texts = F.when(s["cap"].isNotNull(), F.slice(texts, F.lit(1), s["cap"])).otherwise(texts)
        texts = F.transform(texts, lambda x: F.replace(x, F.lit("‑"), F.lit("-")))
        return F.array_join(F.array_distinct(repair(texts)), "/")

    return F.transform(slots, cell)


def by_tense(found: Column, code: str) -> Column:
    """The cells as one array a tense."""
    at, out = 1, []
    for tense in paradigms.tenses(code):
        out.append(F.slice(found, at, len(tense.slots)))
        at += len(tense.slots)
    return F.array(*out)


def prepared_forms(code: str) -> Column:
    """A verb's forms after the language's repairs, before its filter, over ``_forms`` of the entry."""
    forms, word = F.col("_forms"), F.col("word")
    if code == "la":
        return latin_forms(forms, word)
    if code == "fi":
        return finnish_forms(forms, word, F.col("senses"))
    if code == "pt":
        return portuguese_forms(forms, word, F.col("head_templates"))
    if code == "ca":
        return catalan_forms(forms, word)
    if code == "nl":
        return dutch_forms(forms)
    if code == "sv":
        return swedish_forms(forms, word, F.col("inflection_templates"))
    return forms


def conjugations(entries: DataFrame, code: str) -> DataFrame:
    """(src_ord, word, name_plain, conjugation, gloss, aspirated) of the language's verb roots that have a cell.

    ``conjugation`` is one array of cells a tense, in the order of ``paradigms.tenses``.
    """
    roots = entries.where((F.col("lang_code") == code) & verbs.is_verb_root()).withColumn("_forms", simple(F.col("forms")))
    if code in ("la", "fi"):
        texts = nfc_each(F.transform("_forms", lambda f: f["form"]))
        roots = roots.withColumn("_texts", texts).withColumn("_forms", F.zip_with("_forms", "_texts", lambda f, x: _form(x, f["tags"], f["source"])))
    roots = roots.withColumn("_forms", prepared_forms(code)).where(F.exists("_forms", lambda f: f["source"] == "conjugation"))
    if code in paradigms.TABLES:
        roots = roots.withColumn("_forms", first_tables(F.col("_forms"), paradigms.TABLES[code]))
    elif code == "el":
        roots = roots.withColumn("_forms", greek_forms(F.col("_forms")))
    clean = verbs.FILTERS.get(code, verbs.clean_form)
    roots = roots.withColumn("_forms", F.filter("_forms", clean)).withColumn("_cells", cells(F.col("_forms"), code))
    return roots.where(F.exists("_cells", lambda c: c != "")).select(
        "src_ord",
        "word",
        t.strip_diacritics(F.col("word")).alias("name_plain"),
        by_tense(F.col("_cells"), code).alias("conjugation"),
        summary_gloss(F.col("senses")).alias("gloss"),
        verbs.is_aspirated().alias("aspirated"),
    )
