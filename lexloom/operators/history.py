"""Reading histories: recent words of each reader, trails of pages, and saved histories that are checked on reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How many recent words and pages a history keeps.
MAX_RECENT = 30
MAX_TRAIL = 100

_RECENT = "array<struct<lang:string,word:string,viewedAt:double>>"
_TRAIL = "struct<entries:array<struct<id:string,url:string,label:string>>,cursor:double>"


def recent(views: DataFrame, within: list[str], item: list[str], seen: str, limit: int = MAX_RECENT) -> DataFrame:
    """(within, item, seen, rank): the items that each reader saw last, once each, newest first.

    Views of one item are one row a task before the shuffle; ranks are cut in every task as well. Ties go
    by item; views without a time come last.
    """
    newest = views.groupBy(*within, *item).agg(F.max(seen).alias(seen))
    order = W.partitionBy(*within).orderBy(F.desc_nulls_last(seen), *item)
    return newest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def trail(visits: DataFrame, within: list[str], order: list[str], limit: int = MAX_TRAIL) -> DataFrame:
    """Visits with ``place``: the last ``limit`` of each reader, numbered from the oldest that is kept."""
    last = W.partitionBy(*within).orderBy(*[F.desc_nulls_last(c) for c in order])
    kept = visits.withColumn("place", F.row_number().over(last)).where(F.col("place") <= limit)
    size = F.count("*").over(W.partitionBy(*within))
    return kept.withColumn("place", (size - F.col("place") + 1).cast("long"))


def valid_recent(raw: Column, languages: list[str], limit: int = MAX_RECENT) -> Column:
    """array<struct<lang, word, viewedAt>> of a saved list; what isn't a known language, a word and a finite time goes.

    The first of equal words stays, in the saved order. A text that is no list gives an empty array.
    """
    saved = F.coalesce(F.from_json(raw, F.lit(_RECENT)), F.array().cast(_RECENT))
    finite = lambda x: x["viewedAt"].isNotNull() & ~F.isnan(x["viewedAt"]) & (F.abs(x["viewedAt"]) < float("inf"))
    good = F.filter(saved, lambda x: F.coalesce(x["lang"].isin(*languages) & (x["word"] != "") & finite(x), F.lit(False)))
    place = lambda rows, x: F.array_position(F.transform(rows, lambda y: F.struct(y["lang"], y["word"])), F.struct(x["lang"], x["word"]))
    return F.get(F.transform(F.array(good), lambda rows: F.slice(F.filter(rows, lambda x, i: place(rows, x) == i + 1), 1, limit)), 0)


def valid_trail(raw: Column, limit: int = MAX_TRAIL) -> Column:
    """struct<entries, cursor> of a saved trail, or an empty trail with cursor -1 if any part of it is wrong.

    Ids are not empty and differ, addresses are local paths, and the cursor is a place of the list.
    """
    saved = F.from_json(raw, F.lit(_TRAIL))
    empty = F.struct(F.array().cast("array<struct<id:string,url:string,label:string>>").alias("entries"), F.lit(-1.0).alias("cursor"))
    local = lambda u: u.startswith("/") & ~u.startswith("//") & ~u.contains("\\")
    right = lambda x: F.coalesce((x["id"] != "") & x["label"].isNotNull() & local(x["url"]), F.lit(False))

    def checked(t: Column) -> Column:
        rows, at = t["entries"], t["cursor"]
        good = (F.size(rows) <= limit) & (at == F.floor(at)) & (at >= 0) & (at < F.size(rows)) & F.forall(rows, right)
        good = good & (F.size(F.array_distinct(F.transform(rows, lambda x: x["id"]))) == F.size(rows))
        return F.when(F.coalesce(good, F.lit(False)), t).otherwise(empty)

    return F.get(F.transform(F.array(saved), checked), 0)
