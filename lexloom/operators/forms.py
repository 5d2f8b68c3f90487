"""Ordered-sequence and tag operators on forms and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tags_match(tags: Column, wanted: Column, excluded: Column) -> Column:
    """Whether all wanted tags are present and none of the excluded."""
    return (F.size(F.array_except(wanted, tags)) == 0) & ~F.coalesce(F.arrays_overlap(tags, excluded), F.lit(False))


def tense_matrix(forms: DataFrame, matchers: DataFrame, keys: list[str], cap: int | None = None) -> DataFrame:
    """(keys, slot, cell): ordered distinct forms that match each slot, joined by '/'.

    ``forms`` has keys, pos, tags and form; ``matchers`` is configuration of a fixed size: slot,
    wanted, excluded, rare. Forms with a rare tag stand in brackets.
    """
    hits = forms.join(F.broadcast(matchers), tags_match(F.col("tags"), F.col("wanted"), F.col("excluded")))
    shown = F.when(F.arrays_overlap("tags", "rare"), F.concat(F.lit("["), F.col("form"), F.lit("]"))).otherwise(F.col("form"))
    firsts = hits.withColumn("form", shown).groupBy(*keys, "slot", "form").agg(F.min("pos").alias("pos"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("pos", "form"))), lambda x: x["form"])
    cells = F.slice(cells, 1, cap) if cap else cells
    return firsts.groupBy(*keys, "slot").agg(F.array_join(cells, "/").alias("cell"))


def first_tables(rows: DataFrame, keys: list[str], order: str, boundary: Column, tables: int) -> DataFrame:
    """Rows of the first tables; boundary rows, which open a new table, are dropped."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("_edge", boundary).withColumn("table_no", F.sum(F.col("_edge").cast("long")).over(w) + 1)
    return numbered.where(~F.col("_edge") & (F.col("table_no") <= tables)).drop("_edge")


def carry_forward(rows: DataFrame, keys: list[str], order: str, label: Column, name: str) -> DataFrame:
    """The last label seen up to and with each row."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(label, ignorenulls=True).over(w))


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: (keys, value, island, first, last, n)."""
    w = W.partitionBy(*keys).orderBy(*order)
    turned = F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True)).cast("long")
    marked = rows.withColumn("_t", turned).withColumn("island", F.sum("_t").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(
        F.first(value).alias(value), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")
    )


def verified_blocks(rows: DataFrame, keys: list[str], order: str, signature: str, layouts: list[list[str]], width: int) -> DataFrame:
    """Rows cut into blocks of ``width``; a group is verified only if all its blocks have a known layout."""
    w = W.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("column", F.col("_i") % width).withColumn("block", F.floor(F.col("_i") / width))
    blocks = numbered.groupBy(*keys, "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("column", signature))), lambda x: x[signature]).alias("layout")
    )
    known = F.array(*[F.array(*[F.lit(x) for x in layout]) for layout in layouts])
    verdict = blocks.groupBy(*keys).agg(F.bool_and(F.array_contains(known, F.col("layout"))).alias("verified"))
    return numbered.join(verdict, keys).drop("_i")


def unsubsumed(readings: Column, grammar: str, *same: str) -> Column:
    """Readings whose grammar is no strict subset of another's with the same other fields."""

    def below(r: Column, o: Column) -> Column:
        smaller = (F.size(F.array_except(r[grammar], o[grammar])) == 0) & (F.size(F.array_except(o[grammar], r[grammar])) > 0)
        for field in same:
            smaller = smaller & r[field].eqNullSafe(o[field])
        return smaller

    return F.filter(readings, lambda r: ~F.exists(readings, lambda o: below(r, o)))


def reading_kind(kinds: Column) -> Column:
    """The strongest kind: inflection, related, variant, other."""
    return F.element_at(F.filter(F.array(*map(F.lit, ("inflection", "related", "variant", "other"))), lambda k: F.array_contains(kinds, k)), 1)


def fewest_rare(df: DataFrame, keys: list[str], rare: Column, order: str, kept: list[str]) -> DataFrame:
    """Per key the row with the fewest rare tags, the first of equals."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(rare, F.col(order))).alias("x")).select(*keys, "x.*")


def filled_cells(cells: Column) -> Column:
    """Number of non-empty strings in an array of arrays."""
    return F.size(F.filter(F.flatten(cells), lambda c: F.coalesce(c, F.lit("")) != "")).cast("long")


def gender(found: Column) -> Column:
    """Genders in the order m, f, n, c, joined by hyphens; null if none."""
    shown = F.array_join(F.filter(F.array(*map(F.lit, "mfnc")), lambda g: F.array_contains(found, g)), "-")
    return F.when(shown != "", shown)


def ordered_grammar(tags: Column, vocabulary: list[str]) -> Column:
    """The known tags in the vocabulary's order, hyphens as spaces."""
    known = F.array(*map(F.lit, vocabulary))
    return F.array_join(F.transform(F.filter(known, lambda t: F.array_contains(tags, t)), lambda t: F.replace(t, F.lit("-"), F.lit(" "))), " ")
