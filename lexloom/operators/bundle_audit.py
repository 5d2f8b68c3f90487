"""Audits of a language's bundle: its records, its search index, and whether two builds are equal.

Records are (name, conjugation array<array<string>>, freq double): one array of cells a tense. ``shape``
has (tense, number of cells) in order and is configuration. All findings are rows, so that a bundle is
good if there are none; rows that are equal more than once count so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Shape = list[tuple[str, int]]

# What no cell of a table may hold, the range of frequencies, and the most ids a prefix has.
DIRTY = r"\{\{|\}\}|\[\[|\]\]|Template:|Module:|<[^>]+>|\b(?:Lua|Script) error\b|�|[\x00-\x08\x0b\x0c\x0e-\x1f]"
FREQUENCY = (0.0, 8.0)
PREFIX_IDS = 200


def _finding(reason: str, tense: Column | None = None) -> Column:
    return F.struct(F.lit(reason).alias("reason"), (F.lit(None) if tense is None else tense).cast("string").alias("tense"))


def _cells(table: Column) -> Column:
    return F.filter(F.flatten(F.filter(table, lambda r: r.isNotNull())), lambda c: c.isNotNull())


def record_findings(shape: Shape) -> Column:
    """array<struct<reason, tense>> of one record, in the order of the checks.

    A table with another number of tenses, or none, has that finding alone. A tense without cells, with
    another number of them or with a null cell has a wrong shape. A null frequency is 0; one that is not
    finite or out of range is a finding.
    """
    table, freq = F.col("conjugation"), F.coalesce("freq", F.lit(0.0))
    none = F.array().cast("array<struct<reason:string,tense:string>>")
    if_so = lambda bad, found: F.when(bad, F.array(found)).otherwise(none)
    config = F.array(*[F.struct(F.lit(name).alias("tense"), F.lit(n).alias("n")) for name, n in shape])
    crooked = F.filter(
        F.zip_with(table, config, lambda r, s: F.struct((r.isNull() | (F.size(r) != s["n"]) | F.exists(r, lambda c: c.isNull())).alias("bad"), s["tense"].alias("tense"))),
        lambda x: F.coalesce(x["bad"], F.lit(True)),
    )
    cells = _cells(table)
    whole = F.concat(
        F.transform(crooked, lambda x: F.struct(F.lit("wrong row shape").alias("reason"), x["tense"].alias("tense"))),
        if_so(~F.exists(cells, lambda c: c != ""), _finding("empty table")),
        if_so(F.exists(cells, lambda c: c.rlike(DIRTY)), _finding("dirty cell")),
        # NaN is above every number here.
        if_so(~freq.between(*FREQUENCY), _finding("invalid frequency")),
    )
    return F.when(F.coalesce(F.size(table), F.lit(-1)) == len(shape), whole).otherwise(F.array(_finding("wrong tense count")))


def record_violations(records: DataFrame, shape: Shape) -> DataFrame:
    """(name, reason, tense, n) of all records that break a rule; a name's second record is a duplicate root.

    Each row is checked where it lies; one sum by name, reason and tense follows, which a hot name
    enters as one row a task. An empty table has no rows here.
    """
    first = F.struct(F.lit("duplicate root").alias("reason"), F.lit(None).cast("string").alias("tense"))
    found = records.select("name", F.inline(F.concat(F.array(first), record_findings(shape))))
    counted = found.groupBy("name", "reason", "tense").agg(F.count("*").alias("n"))
    seconds = F.when(F.col("reason") == "duplicate root", F.col("n") - 1).otherwise(F.col("n"))
    return counted.withColumn("n", seconds).where("n > 0")


def filled_cells(records: DataFrame, shape: Shape) -> DataFrame:
    """(tense, filled, total) cells of each tense over all records; cells that the shape has no tense for are left out."""
    names = F.array(*[F.lit(name) for name, _ in shape])
    rows = records.select(F.posexplode("conjugation").alias("place", "cells")).where(F.col("place") < len(shape))
    filled = F.size(F.filter("cells", lambda c: F.coalesce(c != "", F.lit(False))))
    sizes = rows.select(F.get(names, F.col("place")).alias("tense"), F.when(F.col("cells").isNotNull(), filled).otherwise(0).alias("f"), F.coalesce(F.size("cells"), F.lit(0)).alias("t"))
    return sizes.groupBy("tense").agg(F.sum("f").alias("filled"), F.sum(F.greatest("t", F.lit(0))).alias("total"))


def samples(records: DataFrame, n: int) -> DataFrame:
    """(kind, rank, name, measure): n records by the digest of their names, the sparsest, and those with most variants in a cell.

    Ties go by name. Each kind is a top-k, kept in every task before one merge.
    """
    cells = _cells(F.col("conjugation"))
    filled = F.size(F.filter(cells, lambda c: c != ""))
    most = F.coalesce(F.array_max(F.transform(F.filter(cells, lambda c: c != ""), lambda c: F.size(F.split(c, "/", -1)))), F.lit(0))
    measured = records.where("name is not null").select("name", F.sha2("name", 256).alias("digest"), F.greatest(F.coalesce(filled, F.lit(0)), F.lit(0)).alias("filled"), most.alias("most"))
    kinds = {"digest": (F.col("digest"), F.lit(None)), "sparse": (F.col("filled"), F.col("filled")), "variants": (-F.col("most"), F.col("most"))}
    made = None
    for kind, (order, measure) in kinds.items():
        top = measured.select(order.alias("o"), "name", measure.cast("long").alias("measure")).orderBy("o", "name").limit(n)
        listed = top.agg(F.array_sort(F.collect_list(F.struct("o", "name", "measure"))).alias("x")).select(F.lit(kind).alias("kind"), F.posexplode("x").alias("place", "x"))
        rows = listed.select("kind", (F.col("place") + 1).alias("rank"), "x.name", "x.measure")
        made = rows if made is None else made.unionAll(rows)
    return made


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that one table holds more often than the other, with ``surplus``: above 0 in ``actual``, below 0 in ``expected``.

    The tables have the same columns, in any order; nulls are equal. Both are summed in one shuffle, so equal
    rows meet as counts, however many there are. No rows: the tables are equal as multisets.
    """
    names = expected.columns
    if sorted(names) != sorted(actual.columns):
        raise ValueError(f"columns differ: {sorted(names)} and {sorted(actual.columns)}")
    signed = expected.select(*names, F.lit(-1).cast("long").alias("_sign")).unionByName(actual.select(*names, F.lit(1).cast("long").alias("_sign")))
    return signed.groupBy(*names).agg(F.sum("_sign").alias("surplus")).where("surplus <> 0")


def index_violations(index: DataFrame, records: DataFrame, most: int | None = PREFIX_IDS) -> DataFrame:
    """(prefix, reason) of index rows (prefix, ids array<long>) that name no place of ``records``, or break a rule."""
    size = records.agg(F.count("*").alias("size"))  # one row
    outside = F.exists("ids", lambda i: i.isNull() | (i < 0) | (i >= F.col("size")))
    reason = (
        F.when(F.coalesce(F.col("prefix"), F.lit("")) == "", "no prefix")
        .when(F.col("ids").isNull() | (F.size("ids") == 0), "no ids")
        .when(outside, "id out of range")
    )
    if most is not None:
        reason = reason.when(F.size("ids") > most, "too many ids")
    return index.crossJoin(F.broadcast(size)).select("prefix", reason.alias("reason")).where("reason is not null")


def download_problems(verbs: DataFrame, index: DataFrame, shape: Shape) -> DataFrame:
    """(reason, n) of a downloaded bundle: verbs (name, name_plain, freq, conjugation) and index (prefix, ids).

    A bundle without verbs or without an index is a problem of its own. A tense that is one text in the
    source is an array of one cell here.
    """
    sizes = F.array(*[F.lit(n) for _, n in shape])
    table = F.col("conjugation")
    incompatible = (
        (F.coalesce("name", F.lit("")) == "") | F.col("name_plain").isNull() | F.col("freq").isNull() | F.isnan("freq")
        | F.abs("freq").eqNullSafe(float("inf")) | (F.coalesce(F.size(table), F.lit(-1)) != len(shape))
    )
    fits = F.zip_with(table, sizes, lambda r, n: F.coalesce((F.size(r) == n) & ~F.exists(r, lambda c: c.isNull()), F.lit(False)))
    reason = F.when(incompatible, "incompatible conjugation data").when(~F.forall(fits, lambda x: x), "incompatible pronoun data")
    records = verbs.select(reason.alias("reason")).where("reason is not null")
    places = index_violations(index, verbs, None).select(F.lit("invalid search references").alias("reason"))
    empty = lambda df, text: df.agg(F.count("*").alias("k")).where("k = 0").select(F.lit(text).alias("reason"))
    found = records.unionAll(places).unionAll(empty(verbs, "no verbs")).unionAll(empty(index, "no search index"))
    return found.groupBy("reason").agg(F.count("*").alias("n"))
