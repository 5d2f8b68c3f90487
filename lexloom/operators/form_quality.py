"""Quality of inflected forms: reasons to reject a source text, person columns of tables, and spelling variants.

All are Columns. A text gets the first reason of one ordered table of decisions; texts without a reason
become any number of spellings with qualifiers. Null texts have no reason and no spelling; null tags,
sources and languages count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.operators.conjugation import FORMS, bound

VARIANT = "array<struct<form:string,qualifiers:array<string>>>"

# Texts, patterns, tags and languages of the decisions.
TABLE_SOURCES = ("conjugation", "declension", "inflection")
PLACEHOLDERS = ("[please provide]", "[Term?]", "Term?", "?", "—", "–", "- —")
LATVIAN_PRONOUNS = ("es", "tu", "viņš", "viņa", "mēs", "jūs", "viņi", "viņas")
SIGN_NAMES = "Comma|Semicolon|Colon|Full stop|Question mark|Exclamation|Hyphen|Dash|Quotation|Letter|Digit|Number|Capital"
PERSON_TAGS = ("first-person", "second-person", "third-person", "singular", "plural")
FINITE = ("aorist", "continuative", "progressive", "inferential", "future", "past", "conditional", "optative", "necessitative", "imperative")
PERSONS, NUMBERS = ("first-person", "second-person", "third-person"), ("singular", "plural")
COLUMNS = [sorted((p, n)) for n in NUMBERS for p in PERSONS]
LAYOUTS = (COLUMNS, [*COLUMNS[2:], [], []], [[], *COLUMNS[1:]])
WRAPPERS = {"[": ("]", ("rare",)), "{": ("}", ("learned", "archaic")), "(": (")", ("optional or informal",))}
KEEP_SUFFIX = ("affix", "suffix", "prefix", "combining_form")
NOTED = ("it", "az", "ka", "mk", "he", "sa", "id")
COMMA_LISTS = ("fr", "it", "la", "eu", "grc", "vi")


def _texts(values=()) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _rules(lang: Column, text: Column, tags: Column, source: Column, heads: Column) -> list[tuple[str, Column]]:
    """(reason, test) in order; the first test that holds names the reason."""
    table = source.isin(*TABLE_SOURCES)
    any_of = lambda *names: F.arrays_overlap(tags, _texts(names))
    has = lambda name: F.array_contains(tags, name)
    broken = F.exists(heads, lambda h: (h["name"] == "lv-part") & h["expansion"].contains("|#default="))
    starts = lambda *heads: F.lit(False) if not heads else text.startswith(heads[0]) | starts(*heads[1:])
    lv, nn, fr = lang == "lv", lang == "nn", lang == "fr"
    return [
        ("broken-paradigm", lv & broken),
        ("table-header", lv & (text == "conjugation") & any_of(*PERSONS)),
        ("table-header", lv & (text == "declension") & has("irregular")),
        ("unexpanded-template", lv & text.contains("|") & text.contains("=")),
        ("table-pronoun", lv & (source == "conjugation") & text.isin(*LATVIAN_PRONOUNS)),
        ("usage-note", nn & (text.rlike(r"^since \d{4}$") | text.startswith("Forms in [brackets] were considered"))),
        ("usage-note", (lang == "tl") & text.isin("superseded", "pre-2007") & has("alternative")),
        ("unexpanded-template", (lang == "bg") & table & text.contains("+")),
        ("placeholder", text.isin(*PLACEHOLDERS)),
        ("table-instruction", (lang == "fi") & ((text == "Rare. Only used with substantive adjectives.") | text.startswith("Regularly derivable colloquial forms"))),
        ("table-instruction", (lang == "cs") & starts("When the verb ", "The verb ")),
        ("table-instruction", (lang == "hu") & text.startswith("(and the concomitant changes in conditional and subjunctive")),
        ("construction-instruction", fr & table & text.rlike(r"^(?:present|past|imperfect|future|pluperfect).*\bof\b")),
        ("detached-auxiliary", fr & table & has("multiword-construction") & text.isin("ayant", "étant", "avoir", "être")),
        ("table-header", lang.isin("it", "de", "ru") & table & text.isin("infinitive", "imperative", "declension")),
        ("auxiliary-note", (lang == "it") & starts("in the literal meaning ", "the sense ", "in most figurative")),
        ("declension-note", (lang == "la") & text.rlike(r"^(?:First|Second|Third|Fourth|Fifth)-declension noun\b")),
        ("unavailable-form", lang.isin("ro", "ru") & text.isin("not used", "form is not used")),
        ("construction-instruction", lang.isin("ko", "grc") & starts("conjugation of ", "Formed using ")),
        (
            "language-note",
            lang.isin("id", "ms") & (text.isin("or", "(Standard) Malay", "standard Malay") | text.rlike("^(?:nonstandard or standard|standard|nonstandard) (?:Malay|Indonesian)$")),
        ),
        ("translation", (lang == "sv") & has("literally") & text.rlike("[A-Za-z]")),
        ("foreign-table-cell", (lang == "ru") & table & has("error-unrecognized-form") & text.rlike(rf"^(?:{SIGN_NAMES})\b")),
        ("pronunciation-note", (lang == "de") & text.startswith("pronunciation:")),
        ("transliteration-in-table", (lang == "uk") & table & text.rlike("[A-Za-z]") & ~text.rlike("[А-Яа-яІіЇїЄєҐґ]")),
    ]


def rejected_reason(lang: Column, text: Column, tags: Column, source: Column, heads: Column) -> Column:
    """Why a source text is no form of the language's word, or null."""
    rules = _rules(F.coalesce(lang, F.lit("")), text, F.coalesce(tags, _texts()), F.coalesce(source, F.lit("")), heads)
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), reason) for reason, test in rules])


def person_columns(forms: Column) -> Column:
    """Forms of a table of six persons with the person and number of their column.

    Adjacent forms with one source and the same tags but for persons are a run; finite runs are cut
    into rows of six. If every row of a run has a known layout its cells get their columns' persons,
    else they lose theirs. Forms are (form, tags, source) with sorted tags.
    """
    rest = lambda f: F.array_except(f["tags"], _texts(PERSON_TAGS))
    start = F.array().cast(f"array<struct<source:string,rest:array<string>,forms:{FORMS}>>")

    def step(runs: Column, f: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        own = F.struct(f["source"].alias("source"), rest(f).alias("rest"), F.array(f).alias("forms"))
        longer = F.struct(last["source"].alias("source"), last["rest"].alias("rest"), F.array_append(last["forms"], f).alias("forms"))
        same = (F.size(runs) > 0) & last["source"].eqNullSafe(f["source"]) & (last["rest"] == rest(f))
        return F.when(F.coalesce(same, F.lit(False)), F.array_append(F.slice(runs, F.lit(1), F.size(runs) - 1), longer)).otherwise(F.array_append(runs, own))

    layouts = F.array(*[F.array(*[_texts(c) for c in layout]) for layout in LAYOUTS])
    columns = F.array(*[_texts(c) for c in COLUMNS])

    def settled(run: Column) -> Column:
        persons = F.transform(run["forms"], lambda f: F.array_sort(F.array_intersect(f["tags"], _texts(PERSON_TAGS))))
        rows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(persons) - 1) / 6).cast("int"))), lambda i: F.slice(persons, i * 6 + 1, F.lit(6)))
        verified = F.forall(rows, lambda row: F.array_contains(layouts, row))

        def repaired(known: Column) -> Column:
            column = lambda i: F.when(known, F.get(columns, i % 6)).otherwise(_texts())
            return F.transform(run["forms"], lambda f, i: F.struct(f["form"].alias("form"), F.array_sort(F.concat(rest(f), column(i))).alias("tags"), f["source"].alias("source")))

        finite = (run["source"] == "conjugation") & F.arrays_overlap(run["rest"], _texts(FINITE))
        return F.when(F.coalesce(finite, F.lit(False)), bound(verified, repaired)).otherwise(run["forms"])

    return F.flatten(F.transform(F.aggregate(forms, start, step), settled))


# --- Greek variants ------------------------------------------------------------------------

_PIECE = r"[\[\]{}()]|\s+[-–—/]\s+|,\s*|(?:(?!\s+[-–—/]\s+)[^\[\]{}(),])+"
_SPLITS = r"^(?:\s+[-–—/]\s+|,\s*)$"


def outer_parts(c: Column) -> Column:
    """The text cut at dashes, slashes and commas outside all brackets; parts are trimmed."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), _texts().alias("done"))

    def step(a: Column, x: Column) -> Column:
        deeper = F.when(x.isin("[", "{", "("), a["depth"] + 1).when(x.isin("]", "}", ")"), F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        cut = (a["depth"] == 0) & x.rlike(_SPLITS)
        done = F.when(cut, F.array_append(a["done"], F.trim(a["now"]))).otherwise(a["done"])
        return F.struct(deeper.alias("depth"), F.when(cut, "").otherwise(F.concat(a["now"], x)).alias("now"), done.alias("done"))

    return F.aggregate(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)), start, step, lambda a: F.array_append(a["done"], F.trim(a["now"])))


def whole_wrapper(c: Column) -> Column:
    """Whether one pair of brackets holds the whole text and all brackets inside match."""
    start = F.struct(F.lit("").alias("open"), F.lit(True).alias("good"), F.lit(0).alias("closed"))

    def step(a: Column, x: Column) -> Column:
        top = F.substring(a["open"], F.length(a["open"]), F.lit(1))
        opens = x.isin("[", "{", "(")
        closes = x.isin("]", "}", ")")
        match = F.concat(top, x).isin("[]", "{}", "()")
        now = F.when(opens, F.concat(a["open"], x)).when(closes, F.substring(a["open"], F.lit(1), F.greatest(F.length(a["open"]) - 1, F.lit(0)))).otherwise(a["open"])
        return F.struct(now.alias("open"), (a["good"] & (~closes | match)).alias("good"), (a["closed"] + F.when(closes & (now == ""), 1).otherwise(0)).alias("closed"))

    ends = F.concat(F.substring(c, F.lit(1), F.lit(1)), F.substring(c, F.length(c), F.lit(1))).isin("[]", "{}", "()")
    # Closed once, and by its last character: nothing stands outside the pair.
    inside = F.aggregate(F.split(c, ""), start, step, lambda a: a["good"] & (a["open"] == "") & (a["closed"] == 1))
    return (F.length(c) >= 3) & ends & inside


def greek_variants(text: Column, keep_suffix: Column) -> Column:
    """Spellings with qualifiers of a Greek cell; wrappers around whole spellings are labels of use."""
    particle = F.when(text.startswith("θα "), "θα ").otherwise("")
    item = "array<struct<text:string,qualifiers:array<string>,done:boolean>>"

    def parted(c: Column, qualifiers: Column) -> Column:
        of = lambda p: F.struct(p.alias("text"), qualifiers.alias("qualifiers"), (~whole_wrapper(p)).alias("done"))
        return F.transform(F.filter(outer_parts(c), lambda p: p != ""), of)

    def opened(x: Column) -> Column:
        sign = F.substring(x["text"], F.lit(1), F.lit(1))
        label = _texts()
        for opens, (_, labels) in WRAPPERS.items():
            label = F.when(sign == opens, _texts(labels)).otherwise(label)
        inner = F.trim(F.substring(x["text"], F.lit(2), F.length(x["text"]) - 2))
        bare = F.when(inner.startswith("θα "), F.substring(inner, F.lit(4), F.length(inner))).otherwise(inner)
        marked = F.when(inner.startswith("θα "), "θα ").otherwise("")
        with_particle = F.transform(parted(bare, F.concat(x["qualifiers"], label)), lambda p: F.struct(F.when(p["done"], F.concat(marked, p["text"])).otherwise(p["text"]).alias("text"), p["qualifiers"].alias("qualifiers"), p["done"].alias("done")))
        return F.when(x["done"], F.array(x)).otherwise(with_particle)

    body = F.when(particle != "", F.substring(text, F.lit(4), F.length(text))).otherwise(text)
    # One step opens one level of wrappers; there are no more levels than opening brackets.
    levels = F.sequence(F.lit(1), F.length(F.regexp_replace(text, r"[^\[({]", "")) + 1)
    found = F.aggregate(levels, parted(body, _texts()).cast(item), lambda items, _: F.flatten(F.transform(items, opened)).cast(item))

    def cleaned(x: Column) -> Column:
        p = F.trim(x["text"])
        return F.struct(F.when(p.startswith("- "), F.trim(F.substring(p, F.lit(3), F.length(p)))).otherwise(p).alias("form"), x["qualifiers"].alias("qualifiers"))

    def good(x: Column) -> Column:
        p = F.regexp_replace(x["form"], "^θα ", "")
        noted = p.rlike(r"[¹²³⁴⁵⁶⁷⁸⁹⁰^]|[A-Za-z]|[\[\]{}]") | p.isin("", "—", "–", "-") | p.rlike("^[‑‐]")
        loose = p.rlike("[()]") & ~p.rlike(r"^[\p{L}\p{N}_̀-ͯ]+\([\p{L}\p{N}_̀-ͯ]+\)$")
        return ~noted & (keep_suffix | ~p.startswith("-")) & ~loose & p.rlike(r"\p{IsGreek}")

    kept = F.filter(F.transform(found, cleaned), good)
    lead = lambda x: F.when((particle != "") & ~x["form"].startswith("θα "), F.concat(particle, x["form"])).otherwise(x["form"])
    return F.transform(kept, lambda x: F.struct(lead(x).alias("form"), x["qualifiers"].alias("qualifiers")))


# --- variants of the other languages ---------------------------------------------------------


def spelling_variants(lang: Column, pos: Column, text: Column, tags: Column) -> Column:
    """(form, qualifiers) of every spelling that a text without a reason to reject it states."""
    one = lambda form, *q: F.array(F.struct(form.alias("form"), (F.array(*q) if q else _texts()).alias("qualifiers")))
    many = lambda forms: F.transform(forms, lambda x: F.struct(x.alias("form"), _texts().alias("qualifiers")))
    trimmed = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    tags = F.coalesce(tags, _texts())

    def hungarian(v: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(v, r"\s+or$", ""), r"^or\s+", "")
        bare = F.regexp_replace(bare, r"^(.+?)\s+\(or ([^()]+)\)$", "$1 or $2")
        return F.when(v.rlike("[{}]"), F.array().cast(VARIANT)).otherwise(many(trimmed(F.split(bare, " or "))))

    def noted(v: Column) -> Column:
        note, word = r"^(.+?)\s+\(([^()]*)\)$", r"^\((rare)\)\s+(.+)$"
        held = v.rlike(note) & F.regexp_extract(v, note, 2).rlike('[“”"A-Za-z]')
        form = F.when(held, F.regexp_extract(v, note, 1)).otherwise(v)
        q = F.when(held, F.array(F.trim(F.regexp_extract(v, note, 2)))).otherwise(_texts())
        rare = (lang == "it") & form.rlike(word)
        q = F.when(rare, F.array_append(q, F.lit("rare"))).otherwise(q)
        form = F.when(rare, F.regexp_extract(form, word, 2)).otherwise(form)
        form = F.when(lang == "it", F.regexp_replace(form, r"\s+[mf]$", "")).otherwise(form)
        mixed = (lang == "ka") & form.rlike("[A-Za-z]") & form.rlike("[ა-ჰ]")
        return F.when(mixed, F.array().cast(VARIANT)).otherwise(F.array(F.struct(form.alias("form"), q.alias("qualifiers"))))

    def listed(found: Column) -> Column:
        """Alternatives in one field, where every one is a single word."""
        x = F.get(found, 0)
        parts = F.split(x["form"], r",\s+")
        whole = F.forall(parts, lambda p: (p != "") & ~p.rlike(r"\s")) & ~x["form"].rlike(r'[()\[\]“”"]')
        may = F.array_contains(tags, "alternative") & ~pos.isin("phrase", "proverb") & lang.isin(*COMMA_LISTS) & (F.size(found) == 1)
        return F.when(may & whole, F.transform(parts, lambda p: F.struct(p.alias("form"), x["qualifiers"].alias("qualifiers")))).otherwise(found)

    danish, breton = r"^\(([^()]+)\)\s+(.+)$", r"^(.+?)\s+\(auxiliary verb: ([^()]+)\)$"
    shown = lambda c: F.replace(F.replace(c, F.lit("/"), F.lit(" / ")), F.lit("  "), F.lit(" "))
    icelandic = r"^(?:conjugation|declension): "
    found = (
        F.when(lang == "el", greek_variants(text, pos.isin(*KEEP_SUFFIX)))
        .when(lang == "hu", hungarian(text))
        .when((lang == "nn") & text.startswith("(alternative case) "), one(F.substring(text, F.lit(20), F.length(text)), F.lit("alternative case")))
        .when((lang == "gd") & text.endswith(" (archaic)"), one(F.substring(text, F.lit(1), F.length(text) - 10), F.lit("archaic")))
        .when((lang == "da") & text.rlike(r"^\((?:have|være)\s*/") & text.rlike(danish), one(F.regexp_extract(text, danish, 2), F.concat(F.lit("auxiliary: "), shown(F.regexp_extract(text, danish, 1)))))
        .when((lang == "br") & text.rlike(breton), one(F.regexp_extract(text, breton, 1), F.concat(F.lit("auxiliary: "), F.regexp_extract(text, breton, 2))))
        .when((lang == "is") & text.rlike(icelandic), many(F.split(F.regexp_replace(text, icelandic, ""), r"\s+[–—-]\s+")))
        .when(lang.isin(*NOTED), noted(text))
        .when(lang.isin("de", "ga") & text.rlike("[<>]$"), one(F.substring(text, F.lit(1), F.length(text) - 1)))
        .otherwise(one(text))
    )
    split = ~F.coalesce(lang.isin("el", "hu", "is"), F.lit(False))
    out = bound(found, lambda f: F.when(split, listed(f)).otherwise(f))
    return F.when(text.isNotNull(), out).otherwise(F.array().cast(VARIANT))


def normalized(lang: Column, pos: Column, text: Column, tags: Column, source: Column, heads: Column) -> Column:
    """(reason, variants): the reason that rejects a text, or its spellings."""
    reason: Callable[[Column], Column] = lambda r: F.struct(r.alias("reason"), F.when(r.isNull(), spelling_variants(lang, pos, text, tags)).otherwise(F.array().cast(VARIANT)).alias("variants"))
    return bound(rejected_reason(lang, text, tags, source, heads), reason)
