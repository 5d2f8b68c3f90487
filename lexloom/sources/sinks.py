"""Sinks: chunks, name indexes, manifests, sitemaps and compressed fields."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as t

#: Fields under this many bytes stay as they are.
LEAST_FIELD = 512
MAGIC = b"LZJ1"


def letter_chunks(df: DataFrame, name: str, order: str) -> DataFrame:
    """Rows with ``letter``; of equal names in a chunk the last one stays."""
    rows = df.withColumn("letter", t.chunk_letter(F.col(name)))
    row = F.struct(*rows.columns)
    return rows.groupBy("letter", name).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def write_chunks(df: DataFrame, path: str, lang: str, name: str, order: str) -> None:
    letter_chunks(df, name, order).write.mode("overwrite").partitionBy(lang, "letter").json(path)


def name_index(df: DataFrame, name: str, order: str) -> DataFrame:
    """Distinct names with their first place."""
    return df.groupBy(name).agg(F.min(order).alias("first"))


def content_manifest(df: DataFrame, within: str, line: str, order: str) -> DataFrame:
    """(within, hash, size): first 8 hex of an MD5 over MD5s of lines in order, and bytes with line ends.

    Lines are hashed where they are; a group's task holds 4096 hashes' digest per block of rows.
    """
    rows = df.select(within, F.col(order).alias("o"), F.md5(line).alias("h"), (F.octet_length(line) + 1).cast("long").alias("b"))
    blocks = rows.groupBy(within, F.floor(F.col("o") / 4096).alias("k")).agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "")).alias("h"), F.sum("b").alias("b")
    )
    return blocks.groupBy(within).agg(
        F.substring(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")), 1, 8).alias("hash"),
        F.sum("b").alias("size"),
    )


def file_manifest(df: DataFrame) -> DataFrame:
    """(path, hash, size) of rows that Spark's binaryFile reader gives."""
    return df.select("path", F.substring(F.md5("content"), 1, 8).alias("hash"), F.col("length").alias("size"))


def sitemap_pages(df: DataFrame, lang: str, name: str, base: str, per_page: int = 40_000) -> DataFrame:
    """(lang, page, url): distinct quoted names in order of name, paged.

    No language is sorted as a whole: names are numbered among those of equal first four characters, and
    a table of the blocks' sizes gives each block its offset. Rows without a language have no url.
    """
    names = df.select(lang, name).distinct().withColumn("_head", F.substring(name, 1, 4))
    sizes = names.groupBy(lang, "_head").agg(F.count("*").alias("_size"))
    before = W.partitionBy(lang).orderBy("_head").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col(lang).alias("_lang"), F.col("_head").alias("_block"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_from"))
    numbered = names.withColumn("_at", F.row_number().over(W.partitionBy(lang, "_head").orderBy(name)))
    placed = numbered.join(offsets, F.col(lang).eqNullSafe(F.col("_lang")) & F.col("_head").eqNullSafe(F.col("_block")))
    page = F.floor((F.col("_from") + F.col("_at") - 1) / per_page).cast("long")
    return placed.select(lang, page.alias("page"), F.concat(F.lit(f"{base}/"), F.col(lang), F.lit("/"), t.url_quote(F.col(name))).alias("url"))


def encode_fields(df: DataFrame, key: str, field: str, level: int = 6) -> DataFrame:
    """(key, field as binary): magic, size and a zstd frame where that is smaller, else the bytes as they are."""

    def run(batches):
        import zstandard

        codec = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                raw = None if value is None else value.encode()
                if raw is not None and len(raw) >= LEAST_FIELD:
                    packed = MAGIC + len(raw).to_bytes(4, "little") + codec.compress(raw)
                    raw = packed if len(packed) < len(raw) else raw
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "field"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(field).alias("field")).mapInArrow(run, "key long, field binary").toDF(key, field)


def decode_fields(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, field as text): the inverse of ``encode_fields``; a wrong size is an error."""

    def run(batches):
        import zstandard

        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                if raw is not None and raw[:4] == MAGIC:
                    size = int.from_bytes(raw[4:8], "little")
                    raw = codec.decompress(raw[8:], max_output_size=size)
                    if len(raw) != size:
                        raise ValueError("field size differs from its header")
                out.append(None if raw is None else raw.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "field"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(field).alias("field")).mapInArrow(run, "key long, field string").toDF(key, field)
