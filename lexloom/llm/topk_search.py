"""Operator 5: exact top-k search by tiled matrix products.

Vectors are cut into tiles; every tile is multiplied with one block of queries at a time, a
partial selection keeps the best k of the tile for each query, and per-task lists are merged
in a tree: tiles within a task, tasks within a group, groups within a query.

A block holds at most ``block`` queries, which is the only thing that is broadcast; further
blocks take further scans, so memory is the same at every size. Scores are integer inner
products of ``floor(256 * x)``: float64 products are exact while their sums stay below 2**53,
which is checked for each tile; beyond it, Python integers are used. Scores beyond 64 bits rank and
are reported as the largest or the smallest long (the smallest is -(2**63 - 1)).

Vectors that are null, empty, of another length than a query's, or that hold null or
non-finite components take no part in that query's result, and such queries give no rows. Ties
go to the smaller id; repeated ids are candidates of their own, but a query never meets rows of
its own id, and an id that is asked more than once is asked with its smallest vector. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import importable

#: Queries of one block and vectors of one tile.
BLOCK, TILE = 4096, 2048
#: The largest score that is reported.
MOST = 2**63 - 1
#: Groups of tasks that are merged before queries are.
FAN = 64

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _grid(lists: list) -> np.ndarray:
    """floor(256 * x) as float64, or as Python integers where that leaves a double's range; all are whole numbers."""
    x = np.asarray(lists, dtype=np.float64)
    with np.errstate(over="ignore"):
        grid = np.floor(256.0 * x)
    if np.isfinite(grid).all():
        return grid
    # Doubles this large are whole numbers themselves.
    return np.array([[256 * int(v) if abs(v) >= 2**53 else math.floor(256 * v) for v in row] for row in x], object)


def _product(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond 64 bits are the largest or the smallest long."""
    if object not in (queries.dtype, tile.dtype):
        with np.errstate(over="ignore"):
            top = np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * max(1, tile.shape[1])
        if top < 2**53:
            return (queries @ tile.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in queries], object).reshape(queries.shape)
    other = np.array([[int(x) for x in row] for row in tile], object).reshape(tile.shape)
    return np.clip(whole.dot(other.T), -MOST, MOST).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row as (row, column ids, scores); columns come in order of id.

    Rows are first cut to what reaches the k-th score, so that ties are settled by id.
    """
    mine = own[:, None] == ids[None, :]
    n = scores.shape[1]
    # Keys of scores this large would leave 64 bits.
    if scores.dtype != object and n * (int(np.abs(scores).max(initial=0)) + 1) >= 2**63:
        scores = scores.astype(object)
    if scores.dtype == object:
        rows, found, values = [], [], []
        for r in range(len(scores)):
            order = sorted((-s, i) for s, i, m in zip(scores[r], ids, mine[r], strict=True) if not m)[:k]
            rows += [r] * len(order)
            found += [i for _, i in order]
            values += [-s for s, _ in order]
        return np.array(rows, np.int64), np.array(found, np.int64), np.array(values, object)
    # Keys are unique but for the query's own rows: the score, then the place in order of id.
    keys = np.where(mine, np.iinfo(np.int64).min, scores * n - np.arange(n))
    top = np.argpartition(keys, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), scores.shape)
    rows = np.repeat(np.arange(len(scores)), top.shape[1])
    values = np.take_along_axis(scores, top, 1).ravel()
    keep = ~np.take_along_axis(mine, top, 1).ravel()
    return rows[keep], ids[top].ravel()[keep], values[keep]


def _task(ids: np.ndarray, grid: np.ndarray, k: int):
    """A function from batches of (id, vector) to this task's k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.empty(0, np.int64)
        found = np.empty(0, np.int64)
        values = np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                vec = part.column(1)
                flat = vec.flatten()
                width = grid.shape[1]
                lengths = np.diff(np.asarray(vec.offsets)) if len(vec) else np.empty(0)
                if not len(vec) or not (lengths == width).all():
                    continue
                tile_ids = np.asarray(part.column(0))
                order = np.argsort(tile_ids, kind="stable")
                tile = _grid(np.asarray(flat).reshape(-1, width))[order]
                scores = _product(grid, tile)
                r, f, v = _best(scores, tile_ids[order], ids, k)
                rows, found, values = np.concatenate([rows, r]), np.concatenate([found, f]), np.concatenate([values, v])
                order = np.lexsort((found, -values, rows)) if values.dtype != object else np.array(
                    sorted(range(len(rows)), key=lambda i: (rows[i], -values[i], found[i])), np.int64
                )
                rows, found, values = rows[order], found[order], values[order]
                first = np.searchsorted(rows, rows)
                keep = np.arange(len(rows)) - first < k
                rows, found, values = rows[keep], found[keep], values[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[rows], pa.int64()), pa.array(found, pa.int64()), pa.array([int(x) for x in values], pa.int64())],
            schema=_OUT,
        )

    return run


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vector as array<double>) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).alias("id"), vec.alias("vec"))
    return rows.where(F.col("id").isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(False)))


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best vectors of every query."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).withColumn("width", F.size("vec"))
    # Blocks of one width: a query's number within its width, counted without a global sort of vectors.
    spans = asked.groupBy("width").agg(F.count("*").alias("n")).collect()
    partial = None
    for width, n in ((r["width"], r["n"]) for r in sorted(spans, key=lambda r: r["width"])):
        of = asked.where(F.col("width") == width)
        parts = -(-n // block)
        tiles = rows.where(F.size("vec") == width)
        for p in range(parts):
            # Each query is in one part by its hash; a part's size is checked before it is used.
            mine = of.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
            pieces = mine.groupBy("id").agg(F.min("vec").alias("vec")).toArrow()
            ids = np.asarray(pieces.column(0).combine_chunks()) if pieces.num_rows else np.empty(0, np.int64)
            if not len(ids):
                continue
            vecs = _grid(np.asarray(pieces.column(1).combine_chunks().flatten()).reshape(-1, width))
            ids, at = np.unique(ids, return_index=True)
            vecs = vecs[at]
            for start in range(0, len(ids), block):
                got = tiles.mapInArrow(
                    _task(ids[start : start + block], vecs[start : start + block], k),
                    "query_id long, vec_id long, score long",
                )
                partial = got if partial is None else partial.union(got)
    if partial is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    grouped = partial.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    for keys in (["query_id", "part"], ["query_id"]):
        grouped = (
            grouped.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))).alias("all"))
            .select(*keys, F.posexplode(F.slice("all", 1, k)).alias("rank", "x"))
            .select(*keys, (F.col("rank") + 1).alias("rank"), F.col("x.v").alias("vec_id"), (-F.col("x.s")).alias("score"))
        )
    return grouped.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


ORACLE = """
WITH grid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM grid q JOIN grid c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUERIES = {"op5_topk_search": op5_topk_search}
ORACLES = {"op5_topk_search": ORACLE}
