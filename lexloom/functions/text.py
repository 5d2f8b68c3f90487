"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, prefixes, stop words and mappings that results depend on.
UNEXPANDED_MARKUP = (
    r"\{\{|\}\}|\[\[|\]\]|\b(?:Template|Module):\S|(?i:\b(?:Lua|Script) error\b)"
    r"|(?i:</?(?:ref|span|div|br|p|small|sup|sub|table|a|i|b)(?:\s[^>]*|/?)>)"
)
DIRT_PATTERNS = {
    "wiki_markup": r"\{\{|\}\}|\[\[|\]\]",
    "html_markup": r"(?i)</?(?:ref|span|div|br|p|small|sup|sub|table|a|i|b)(?:\s[^>]*|/?)>",
    "extraction_error": r"(?i:Lua error|Script error)|\b(?:Template|Module):\S|\[\[Category:",
    "replacement_character": "\ufffd",
    "control_character": r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]",
    "placeholder_gloss": r"(?i)(?:please (?:add|provide) (?:a |an |the )?(?:definition|translation)|definition (?:needed|missing)|\bno gloss(?: found)?\b)",
}
JUNK_GLOSS_PREFIXES = (
    "used to form",
    "used for forming",
    "used as a",
    "used as an",
    "used with",
    "forms composite",
    "forms the",
    "synonym of",
    "alternative form of",
    "compound of",
    "see the full list",
    "post-1990",
)
GLOSS_STOP_WORDS = (
    "the", "and", "for", "not", "out", "off", "has", "are", "was", "but", "can", "may", "all", "any", "its",
    "also", "been", "into", "from", "with", "that", "this", "than", "when", "very", "more", "most", "such",
    "other", "something", "someone", "oneself", "one's", "etc", "e.g", "e.g.", "especially", "synonym",
    "spelling", "chiefly", "usually", "often", "sometimes",
)
ROMANIZATION = {
    "el": {"ch": "kh", "χ": "kh"},
    "ru": {"šč": "shch", "š": "sh", "č": "ch", "ž": "zh", "x": "kh", "j": "y", "ʹ": "", "ʺ": ""},
    "uk": {"šč": "shch", "š": "sh", "č": "ch", "ž": "zh", "x": "kh", "j": "y", "ʹ": "", "ʺ": ""},
    "bg": {"št": "sht", "š": "sh", "č": "ch", "ž": "zh", "j": "y"},
    "mk": {"dž": "dzh", "ǵ": "gj", "ḱ": "kj", "š": "sh", "č": "ch", "ž": "zh"},
    "sh": {"dž": "dz", "đ": "dj"},
    "ka": {"š": "sh", "č": "ch", "ž": "zh", "ǯ": "j", "ʒ": "dz", "ɣ": "gh", "x": "kh", "c": "ts", "ch": "ch"},
    "grc": {"ch": "kh"},
    "sa": {"ś": "sh", "ṣ": "sh"},
    "ko": {},
    "hi": {"ś": "sh", "ṣ": "sh", "c": "ch", "ch": "ch"},
    "he": {"ḥ": "kh", "ḵ": "kh", "š": "sh", "ṣ": "ts", "ʿ": "", "ʾ": ""},
    "fa": {"š": "sh", "č": "ch", "ž": "zh", "x": "kh", "ā": "â"},
}


@cache
def _bases() -> tuple[str, str]:
    """Every letter whose decomposition is one base and marks, and its base."""
    source, target = [], []
    for point in range(0xC0, sys.maxunicode + 1):
        c = chr(point)
        parts = unicodedata.normalize("NFD", c)
        if parts == c or 0xAC00 <= point <= 0xD7A3:
            continue
        kept = [p for p in parts if unicodedata.category(p) != "Mn"]
        if len(kept) == 1:
            source.append(c)
            target.append(kept[0])
    return "".join(source), "".join(target)


def strip_diacritics(c: Column) -> Column:
    """Letters without their marks. Hangul syllables and the few letters that decompose into several letters stay whole."""
    source, target = _bases()
    plain = c.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, c).otherwise(F.regexp_replace(F.translate(c, source, target), r"\p{Mn}+", ""))


def word_key(c: Column, lang: Column) -> Column:
    """Exact-lookup key of NFC input: lower case, with Turkish and Azeri dotted and dotless i."""
    return F.lower(F.when(lang.isin("tr", "az"), F.translate(c, "Iİ", "ıi")).otherwise(c))


def search_key(c: Column, lang: Column) -> Column:
    """Alias key for queries: optional marks and keyboard variants of some scripts folded."""
    key = word_key(c, lang)
    harakat = "[\u064b-\u0652\u0670]"
    hebrew = strip_diacritics(key)
    persian = F.regexp_replace(F.translate(key, "يك\u200c", "یک"), harakat, "")
    arabic = F.regexp_replace(key, "[\u064b-\u0652\u0670\u0640]", "")
    katakana = "".join(map(chr, range(ord("ァ"), ord("ヶ") + 1)))
    hiragana = "".join(chr(ord(x) - 0x60) for x in katakana)
    return (
        F.when(lang == "grc", F.translate(hebrew, "ς", "σ"))
        .when(lang == "he", hebrew)
        .when(lang == "fa", persian)
        .when(lang == "ar", arabic)
        .when(lang == "ur", F.translate(arabic, "كي", "کی"))
        .when(lang == "ja", F.translate(key, katakana, hiragana))
        .otherwise(key)
    )


def search_text(c: Column, lang: Column) -> Column:
    """The key, and the alias after it where they differ."""
    key, alias = word_key(c, lang), search_key(c, lang)
    return F.when(alias == key, key).otherwise(F.concat_ws(" ", key, alias))


def tokens(c: Column) -> Column:
    """Lower-cased words: everything but letters, marks and numbers separates."""
    spaced = F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}\s]", " ")
    return F.filter(F.split(spaced, r"\s+"), lambda x: x != "")


def clean_text(c: Column) -> Column:
    """Trimmed text, or null where it is empty or bears unexpanded markup."""
    text = F.trim(c)
    return F.when((text != "") & (text.rlike(r"^\p{L}+$") | ~text.rlike(UNEXPANDED_MARKUP)), text)


def is_junk_gloss(c: Column) -> Column:
    low = F.lower(c)
    found = F.lit(False)
    for prefix in JUNK_GLOSS_PREFIXES:
        found = found | low.startswith(prefix)
    return found


def zipf(count: Column, total: Column) -> Column:
    """Zipf frequency: log10 of occurrences per billion words, two decimals."""
    return F.round(F.log10(count / total) + 9, 2)


def _once(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), 0)


def mapped(c: Column, mapping: dict[str, str]) -> Column:
    """All replacements in one pass, the longest key first: keys become private signs, then values."""
    keys = sorted(mapping, key=len, reverse=True)
    for i, key in enumerate(keys):
        c = F.replace(c, F.lit(key), F.lit(chr(0xE000 + i)))
    for i, key in enumerate(keys):
        c = F.replace(c, F.lit(chr(0xE000 + i)), F.lit(mapping[key]))
    return c


def romanization_key(c: Column, lang: str) -> Column:
    """Loose key of a reading in Latin letters; null where the language has no profile."""
    if lang not in ROMANIZATION:
        return F.lit(None).cast("string")
    mapping = ROMANIZATION[lang]
    strict = F.lower(F.trim(c))
    # Values that are named more than once are made once.
    bare = _once(mapped(strict, mapping), strip_diacritics)
    loose = F.trim(F.regexp_replace(F.regexp_replace(mapped(bare, mapping), "[’'ʼʹʺ]", ""), r"[\s-]+", " "))
    return F.when(strict == "", None).otherwise(_once(loose, lambda x: F.when(x == "", strict).otherwise(x)))


# The ordered rewrites of the Greek key; U stands for a settled u.
_GREEK_PAIRS = [("μπ", "b"), ("ντ", "d"), ("γκ", "g"), ("γγ", "ng"), ("τσ", "ts"), ("τζ", "dz")]
_GREEK_VOWELS = [("αι", "e"), ("ει", "i"), ("οι", "i"), ("ου", "U"), ("υι", "i")]
_GREEK_LONG = [("θ", "th"), ("ξ", "ks"), ("χ", "ch"), ("ψ", "ps")]
_LATIN_PAIRS = [("mp", "b"), ("nt", "d"), ("gk", "g"), ("ph", "f")]
_LATIN_VOWELS = [("ei", "i"), ("ai", "e"), ("oi", "i"), ("ou", "U"), ("u", "i"), ("U", "u")]


def greek_phonetic(c: Column) -> Column:
    """One Latin sound key for Greek spellings and their romanised forms."""

    def each(c: Column, pairs: list[tuple[str, str]]) -> Column:
        for a, b in pairs:
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def voiced(c: Column, a: str, e: str, u: str, voiceless: str) -> Column:
        for vowel, plain in ((a, "a"), (e, "e")):
            c = F.regexp_replace(c, f"{vowel}{u}(?=[{voiceless}]|$)", f"{plain}f")
            c = F.regexp_replace(c, f"{vowel}{u}", f"{plain}v")
        return c

    c = each(F.lower(strip_diacritics(c)), _GREEK_PAIRS)
    c = each(voiced(c, "α", "ε", "υ", "πτκθσφχξψ"), _GREEK_VOWELS)
    c = each(F.translate(c, "ηωυαειοβγδζκλμνπρσςτφ", "ioiaeiovgdzklmnprsstf"), _GREEK_LONG)
    c = F.regexp_replace(each(c, _LATIN_PAIRS), "c(?!h)", "k")
    c = F.replace(F.translate(c, "qw", "ko"), F.lit("x"), F.lit("ch"))
    c = F.translate(F.regexp_replace(c, "(?<![ctk])h", "ch"), "y", "i")
    return each(voiced(c, "a", "e", "u", "ptksfc"), _LATIN_VOWELS)


def phonetic(c: Column, lang: Column) -> Column:
    return F.when(lang == "el", greek_phonetic(c)).otherwise(c)


def is_latin(c: Column) -> Column:
    return c.rlike(r"^[\p{IsLatin}\p{M}\p{N}\s]+$")


def whole_word(c: Column, word: str) -> Column:
    """Whether the word stands in the text between non-letters."""
    return c.rlike(r"(?<!\p{L})" + "".join("\\" + x if not x.isalnum() and not x.isspace() else x for x in word) + r"(?!\p{L})")


def url_quote(c: Column) -> Column:
    """Percent-encoding where form encoding differs: space, star and tilde."""
    quoted = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    return quoted


def chunk_letter(c: Column) -> Column:
    """First character of the lower-cased name; anything but letters and digits is an underscore."""
    first = F.substring(F.lower(c), 1, 1)
    return F.when(first.rlike(r"^[\p{L}\p{N}]$"), first).otherwise(F.lit("_"))


def byte_size(n: Column) -> Column:
    """Human-readable size."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2))
        .otherwise(F.format_string("%.1f GB", n / 1024**3))
    )


def sentences(c: Column) -> Column:
    """Trimmed sentences of a text, in order."""
    return F.filter(F.transform(F.split(c, r"[.\n]"), lambda x: F.trim(x)), lambda x: x != "")


def first_parts(parts: Column, n: int) -> Column:
    """The first n distinct parts joined by '; ', with '; ...' after them if there are more."""
    distinct = F.array_distinct(parts)
    shown = F.array_join(F.slice(distinct, 1, n), "; ")
    return F.when(F.size(distinct) > n, F.concat(shown, F.lit("; ..."))).otherwise(shown)


def strip_markers(c: Column) -> Column:
    """A form without the brackets of register around it."""
    return F.regexp_replace(c, r"^[(\[{]+|[)\]}]+$", "")
