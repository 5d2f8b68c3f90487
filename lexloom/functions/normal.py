"""Unicode normal forms. No built-in function composes characters, so these run in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _of(form: str, kind: str):
    def one(x):
        return x if x is None or x.isascii() else unicodedata.normalize(form, x)

    def many(x):
        return None if x is None else [one(y) for y in x]

    f = many if kind == "array<string>" else one
    return F.pandas_udf(lambda s: s.map(f).astype(object).where(s.notna(), None), kind) if kind == "string" else F.pandas_udf(lambda s: pd.Series([f(x) for x in s], dtype=object), kind)


def nfc(c: Column | str) -> Column:
    """Composed text; null stays null."""
    return _of("NFC", "string")(c)


def nfd(c: Column | str) -> Column:
    """Letters and their marks apart."""
    return _of("NFD", "string")(c)


def nfkc(c: Column | str) -> Column:
    """Composed text with width and presentation variants folded."""
    return _of("NFKC", "string")(c)


def nfc_each(c: Column | str) -> Column:
    """Composed texts of an array."""
    return _of("NFC", "array<string>")(c)


def searchable(c: Column | str, lang: Column | str) -> Column:
    """Text as aliases are made from: Japanese with width variants folded, other languages composed."""

    def each(texts, langs):
        forms = langs.map({"ja": "NFKC"}).fillna("NFC")
        return pd.Series([x if x is None or x.isascii() else unicodedata.normalize(f, x) for x, f in zip(texts, forms, strict=True)], dtype=object)

    return F.pandas_udf(each, "string")(c, lang)
