"""Display functions that built-in expressions cannot state; Arrow-batched."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def abbreviated(parts: list[str]) -> str:
    """Variants with what they share written once.

    Whole words that all variants begin or end with are factored out; a variant that only adds to
    the one before it is its suffix in brackets, the last of several alone; others drop the shortest shared start of four
    letters or more.
    """
    if len(parts) < 2:
        return "".join(parts)
    rows = [p.split(" ") for p in parts]
    head = len(os.path.commonprefix(rows))
    head = min(head, min(map(len, rows)))
    front = " ".join(rows[0][:head]) + " " if head else ""
    rest = [r[head:] or [""] for r in rows]
    tail = len(os.path.commonprefix([r[:0:-1] for r in rest]))
    back = " " + " ".join(rest[0][-tail:]) if tail else ""
    words = [" ".join(r[: len(r) - tail]) for r in rest]
    items: list[list[str]] = []
    for w in words:
        if items and w.startswith(items[-1][0]) and len(w) > len(items[-1][0]):
            items[-1][1] = w[len(items[-1][0]) :]
        else:
            items.append([w, ""])
    first = items[0][0]
    shared = [len(os.path.commonprefix([first, w])) for w, _ in items[1:]]
    enough = [n for n in shared if n >= 4]
    if enough:
        cut = min(enough)
        for item, n in zip(items[1:], shared, strict=True):
            if n >= 4 and not first.endswith(item[0][cut:]):
                item[0] = "-" + item[0][cut:]
    shown = [w + (f"({more})" if more else "") for w, more in items]
    return front + shown[0] + "".join(x if x.startswith("(") else "/" + x for x in shown[1:]) + back


def emphasised(text: str, ranges: list[tuple[int, int]]) -> list[tuple[str, bool]]:
    """The text as runs of plain and emphasised code points; ranges outside it count for nothing."""
    marks = [False] * len(text)
    for start, end in ranges:
        if 0 <= start < end <= len(text):
            marks[start:end] = [True] * (end - start)
    runs: list[tuple[str, bool]] = []
    for c, bold in zip(text, marks, strict=True):
        if runs and runs[-1][1] == bold:
            runs[-1] = (runs[-1][0] + c, bold)
        else:
            runs.append((c, bold))
    return runs


def highlighted(gloss: str, term: str) -> list[tuple[str, bool]]:
    """The whole term where it occurs, else the first place of each of its words that does not overlap another."""
    low, sought = gloss.lower(), term.lower()
    at = low.find(sought)
    if at >= 0:
        return emphasised(gloss, [(at, at + len(sought))])
    places = sorted((low.find(w), low.find(w) + len(w)) for w in sought.split() if w in low)
    kept: list[tuple[int, int]] = []
    for place in places:
        if not kept or place[0] >= kept[-1][1]:
            kept.append(place)
    return emphasised(gloss, kept)


def linked(text: str, links: dict[str, str]) -> list[tuple[str, str | None]]:
    """The text as plain runs and (label, target) runs: the longest label at each place, at letter boundaries only."""
    labels = sorted(filter(None, links), key=len, reverse=True)
    runs: list[tuple[str, str | None]] = []
    at = 0
    while at < len(text):
        for label in labels:
            end = at + len(label)
            inside = (at > 0 and label[0].isalnum() and text[at - 1].isalnum()) or (end < len(text) and label[-1].isalnum() and text[end].isalnum())
            if text.startswith(label, at) and not inside:
                runs.append((label, links[label]))
                at = end
                break
        else:
            if runs and runs[-1][1] is None:
                runs[-1] = (runs[-1][0] + text[at], None)
            else:
                runs.append((text[at], None))
            at += 1
    return runs


def highlight(gloss: str, term: str) -> Column:
    """array<struct<text, bold>> of a gloss column and a term column."""

    def each(glosses, terms):
        return pd.Series([None if g is None else [{"text": x, "bold": b} for x, b in highlighted(g, q or "")] for g, q in zip(glosses, terms, strict=True)])

    return pandas_udf(each, "array<struct<text:string,bold:boolean>>")(gloss, term)
