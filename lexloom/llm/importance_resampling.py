"""Operator 12: importance resampling towards a target distribution, by position-table n-grams.

Words are exploded with their places; two ``lead`` columns over each document's places put the
next two words beside each word, so that a row states the one, two and three words that begin
there. Each is hashed to a bucket (CRC-32 of its UTF-8 bytes, modulo ``BUCKETS``) and the table of
places and buckets is written once. Buckets are counted per order and summed, for the corpus
and for the target texts; a bucket's gain is its log ratio in thousandths. The gains, one row a
bucket, are joined back to the three columns of the written table and summed per document. A
document's score is its weight plus Gumbel noise from a hash of its id; the highest scores are drawn.

The texts are shuffled once, by document, and words never are: the windows find their rows in
place. A word's row leaves the window as three small numbers. Ranks come from ranges of the
sorted scores with a table of the ranges' sizes, so no task sorts them all.

Null texts and texts without words have no features: weight 0, never drawn. Rows are documents:
rows of one doc_id are scored apart and have the same noise; equal rows count as often as they
stand and have neighbouring ranks. Rows without an id have the noise of an empty id and come
first among equal scores. Empty tables give an empty result; without target texts only smoothing
counts. Of both tables only the id and the text are read, so extra columns of any name are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Tables, documents

#: Everything but digits, ASCII letters and characters beyond ASCII; A-Z are lower-cased in the words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS, BUCKETS = 3, 10_000
SEED, PERCENT, MIN_WORDS = "42", 5, 20


def numbered(df: DataFrame, tables: Tables, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text), with (variant, copies) if ids are null or stand more than once.

    (doc_id, variant) then tells rows apart and equal rows are counted; only rows of such ids are grouped by text.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    if not shared.limit(1).count():
        return rows
    whole = rows.select("doc_id", F.lit(None).cast("string").alias("variant"), F.lit(1).cast("long").alias("copies"), "text")
    shared = tables.write(shared).withColumnRenamed("doc_id", "_shared")
    same = F.col("doc_id").eqNullSafe(F.col("_shared"))
    again = rows.join(shared, same, "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    variant = F.coalesce(F.sha2("text", 256), F.lit(""))
    return whole.join(shared, same, "left_anti").unionByName(again.select("doc_id", variant.alias("variant"), "copies", "text"))


def bucket(*words: Column) -> Column:
    """The bucket of the words joined by one space."""
    return F.pmod(F.crc32(F.concat_ws(" ", *words).cast("binary")), F.lit(BUCKETS)).cast("smallint")


def position_table(rows: DataFrame) -> DataFrame:
    """(doc_id, variant, copies, b1, b2, b3): one row a word at least one a document; nulls where no n-gram begins."""
    by = [c for c in ("doc_id", "variant") if c in rows.columns]
    own = [c for c in ("doc_id", "variant", "copies") if c in rows.columns]
    split = F.split(F.coalesce("text", F.lit("")), GAP)
    words = rows.repartition(*by).select(*own, F.posexplode(split).alias("place", "word"))
    # Of ASCII words ``lower`` lowers A-Z alone, and faster.
    lowered = F.when(F.octet_length("word") == F.length("word"), F.lower("word")).otherwise(F.translate("word", UPPER, LOWER))
    by_place = Window.partitionBy(*by).orderBy("place")
    words = words.withColumn("word", lowered).withColumns({f"next{k}": F.lead("word", k).over(by_place) for k in range(1, ORDERS)})
    # Splitting leaves an empty string at either end only.
    names = ["word", *(f"next{k}" for k in range(1, ORDERS))]
    found = {"doc_id": F.col("doc_id")}
    found["variant"] = F.col("variant") if "variant" in own else F.lit(None).cast("string")
    found["copies"] = F.col("copies") if "copies" in own else F.lit(1).cast("long")
    for order in range(1, ORDERS + 1):
        parts = [F.col(n) for n in names[:order]]
        there = parts[0] != "" if order == 1 else (parts[0] != "") & (parts[-1] != "")
        found[f"b{order}"] = F.when(there, bucket(*parts))
    return words.select(*(c.alias(n) for n, c in found.items()))


def bucket_counts(places: DataFrame, name: str) -> DataFrame:
    """(bucket, count) over all orders."""
    each = [
        places.where(f"b{k} is not null").groupBy(F.col(f"b{k}").alias("bucket")).agg(F.sum("copies").alias(name)) for k in range(1, ORDERS + 1)
    ]
    whole = each[0]
    for more in each[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("bucket").agg(F.sum(name).alias(name))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) for every bucket, in thousandths of the log of the smoothed ratio."""
    spark = source.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").cast("smallint").alias("bucket"))
    both = every.join(F.broadcast(bucket_counts(source, "s")), "bucket", "left").join(F.broadcast(bucket_counts(target, "t")), "bucket", "left").na.fill(0)
    whole = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + BUCKETS).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + BUCKETS).cast("double")
    return both.join(F.broadcast(whole), F.lit(True)).select("bucket", F.floor(F.log(up / down) * 1000).alias("gain"))


def weigh(places: DataFrame, gain: DataFrame) -> DataFrame:
    """(doc_id, variant, copies, n_words, n_features, weight); ``gain`` has a row a bucket, so it is broadcast."""
    for k in range(1, ORDERS + 1):
        places = places.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"gain{k}"))), f"b{k}", "left")
    summed = [F.coalesce(F.col(f"gain{k}"), F.lit(0)) for k in range(1, ORDERS + 1)]
    counted = [F.count(f"b{k}") for k in range(1, ORDERS + 1)]
    return places.groupBy("doc_id", "variant", "copies").agg(
        F.count("b1").alias("n_words"), sum(counted[1:], counted[0]).alias("n_features"), F.sum(sum(summed[1:], summed[0])).alias("weight")
    )


def noise(seed: str) -> Column:
    """Gumbel noise in thousandths, from 32 bits of the id's hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def ranked(scored: DataFrame, tables: Tables, min_words: int, percent: int) -> DataFrame:
    """``scored`` with ``rank``: from 1 over the drawn rows by score, then id; null for the others."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("_row")]
    ready = tables.write(scored.where(F.col("n_words") >= min_words).orderBy(*order).withColumn("_range", F.spark_partition_id()))
    # One row a range of the sort: as many as it had tasks.
    sizes = ready.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    drawn = ready.count() * percent // 100
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("start")
    ready = ready.join(F.broadcast(starts), "_range").withColumn("rank", place.cast("long"))
    ready = ready.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("_range", "start")
    return ready.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(
    df: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_id: str = "item_id",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; ``rank`` is null for rows not drawn."""
    tables = Tables(df.sparkSession)
    places = tables.write(position_table(numbered(df, tables, id_col, text_col)))
    wanted = tables.write(position_table(numbered(target, tables, target_id, target_text)))
    gain = tables.write(gains(places, wanted))
    scored = weigh(places, gain).withColumn("score", F.col("weight") + noise(seed))
    scored = scored.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("variant", "copies")
    return ranked(tables.write(scored), tables, min_words, percent).drop("_row").withColumnRenamed("doc_id", id_col)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


QUERIES = {"op12_importance_resampling": op12_importance_resampling}
ORACLES: dict[str, str] = {}
