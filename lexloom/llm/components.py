"""Connected components of an edge table by alternating large-star and small-star steps.

No edge set reaches the driver: each round is two aggregations with joins, written to the
shared folder and deleted after the next one, and the driver sees one row of sums. Vertices with many edges are one
pre-aggregated row per task before the shuffle, and their joins are split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Tables


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least of its u's neighbours and u itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("x")).select("u", F.least("u", "x").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every vertex with an edge: the smallest id that can be reached.

    Self-loops and edges with a null end are no edges; repeated edges count once.
    """
    tables = Tables(edges.sparkSession)
    edge = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edge = tables.write(edge.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u go to u's least; small star: those below, and u itself.
        large = _least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        pairs = small.select("v", "m").union(small.select(F.col("u").alias("v"), "m"))
        last, edge = edge, tables.write(pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        now = edge.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        tables.drop(last)
        if now == before:
            break
        before = now
    roots = edge.select(F.col("v").alias("id")).distinct()
    return edge.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
