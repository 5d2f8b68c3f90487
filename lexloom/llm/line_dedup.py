"""Operator 11: line deduplication through a sharded minimal perfect hash.

``line_table`` hashes every line's key (the line without white space at its ends, A-Z lower-cased;
128 bits) of at least ``min_chars`` code points. Keys found in at least ``min_docs`` documents are
dealt to shards by hash, and each shard becomes a minimal perfect hash with three dense arrays under its numbers:
the fingerprint (the hash's second half, 64 bits), the count of documents and the largest doc_id.
Documents do not meet each other's lines: their hashes are dealt to the shards and probe the
arrays, and only the numbers of lines to drop come back to the texts.

A shard's size follows from the number of lines, so no group grows with the input. A key that
holds more than a ``HOT``-th of all repeated lines, of which there are fewer than ``HOT`` by that
very rule, is looked up in a broadcast table instead of its shard, so no shard is hot.

Rows are documents: rows of one doc_id count apart, and all rows of the largest doc_id keep a
line. Rows without an id count, but are never the largest; a line that only they hold stays. A
line repeated inside one document counts once there, and all its places are dropped or stay. Null
and empty texts are one empty line. Equal rows get equal results. An empty table gives an empty
result. Only ``id_col`` and ``text_col`` are read, so extra columns of any name are harmless.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import perfect_hash
from lexloom.llm.common import Tables, documents, map_texts

MIN_CHARS, MIN_DOCS = 20, 3
#: Lines that probe a shard, on average, and the most keys that are looked up outside the shards.
PROBES, HOT = 2**15, 4096

BLANK = b" \t\n\x0b\x0c\r"


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def line_table(df: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, doc_id, line, h1, h2, once): one row a line with a key long enough; ``once`` marks a key's first place in its row."""

    def make():
        digest = xxhash.xxh3_128_digest

        def lines(keys, ids, texts):
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, i, text in zip(keys, ids, texts):
                seen = set()
                for k, line in enumerate((text or b"").split(b"\n")):
                    line = line.strip(BLANK)
                    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode()) < min_chars):
                        continue
                    h = digest(line.lower())  # of bytes: A-Z alone
                    for column, x in zip(out, (key, i, k, h, h not in seen)):
                        column.append(x)
                    seen.add(h)
            halves = np.frombuffer(b"".join(out[3]), "<i8").reshape(-1, 2)
            return {"row_key": out[0], "doc_id": out[1], "line": out[2], "h1": halves[:, 0], "h2": halves[:, 1], "once": out[4]}

        return lines

    rows = df.select(_row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    arrow = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("once", pa.bool_())])
    return map_texts(rows, ["row_key", "doc_id", "text"], make, "row_key long, doc_id long, line int, h1 long, h2 long, once boolean", arrow)


def build_index(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, hash, fingerprints, counts, keepers, kept_by): one row a shard of (h1, h2, n, keeper).

    ``keepers`` are the largest doc_ids; ``kept_by`` is false where no row with an id holds the line.
    """

    def build(shard: pa.Table) -> pa.Table:
        h1, h2, n = (shard[c].to_numpy() for c in ("h1", "h2", "n"))
        packed, number = perfect_hash.build(h1.view("u8"), h2.view("u8"))
        keeper, known = shard["keeper"].fill_null(0).to_numpy(), shard["keeper"].is_valid().to_numpy()
        blobs = []
        for values in (h2, n, keeper, known.astype(np.uint8)):
            dense = np.empty(len(values), values.dtype)
            dense[number] = values
            blobs.append(dense.tobytes())
        return pa.table([[shard["shard"][0].as_py()], [packed], *([b] for b in blobs)], schema=arrow)

    arrow = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("hash", "fingerprints", "counts", "keepers", "kept_by"))])
    schema = "shard long, hash binary, fingerprints binary, counts binary, keepers binary, kept_by binary"
    return repeated.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInArrow(build, schema)


def probe(lines: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(row_key, doc_id, line) of the lines that the index tells to drop."""

    def look(lines: pa.Table, index: pa.Table) -> pa.Table:
        if not index.num_rows or not lines.num_rows:
            return arrow.empty_table()
        blob = lambda name: index[name][0].as_py()
        h1, h2 = lines["h1"].to_numpy(), lines["h2"].to_numpy()
        number = perfect_hash.PerfectHash(blob("hash")).numbers(h1.view("u8"), h2.view("u8"))
        hit = number >= 0
        hit[hit] = np.frombuffer(blob("fingerprints"), "<i8")[number[hit]] == h2[hit]
        at = number[hit]
        keeper, known = np.frombuffer(blob("keepers"), "<i8")[at], np.frombuffer(blob("kept_by"), np.uint8)[at] == 1
        lines = lines.filter(pa.array(hit))
        own, named = lines["doc_id"].fill_null(0).to_numpy(), lines["doc_id"].is_valid().to_numpy()
        return lines.filter(pa.array(known & ~(named & (own == keeper)))).select(arrow.names).cast(arrow)

    arrow = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32())])
    dealt = lines.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard")
    return dealt.cogroup(index.groupBy("shard")).applyInArrow(look, "row_key long, doc_id long, line int")


def dedup_lines(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", probes: int = PROBES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every row with the lines that stay, joined by a line feed."""
    tables = Tables(df.sparkSession)
    lines = tables.write(line_table(df, min_chars, id_col, text_col))
    by_key = lines.groupBy("h1", "h2").agg(F.sum(F.col("once").cast("long")).alias("n"), F.max("doc_id").alias("keeper"))
    repeated = tables.write(by_key.where(F.col("n") >= min_docs))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-lines.count() // probes))
    # Fewer than ``hot`` keys can hold more than one part in ``hot`` of the total.
    often = repeated.where(F.col("n") * hot > total)
    index = tables.write(build_index(repeated.where(F.col("n") * hot <= total), shards))
    met = lines.join(F.broadcast(often.select("h1", "h2", "keeper", F.lit(True).alias("often"))), ["h1", "h2"], "left")
    drops = met.where("often and doc_id <=> keeper = false and keeper is not null").select("row_key", "doc_id", "line")
    drops = drops.unionByName(probe(met.where("often is null").select(*lines.columns), index, shards))
    drops = drops.groupBy("row_key", "doc_id").agg(F.collect_set("line").alias("drops"))
    rows = df.select(_row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    met = rows.join(drops, (F.col("_key") == F.col("row_key")) & F.col("_id").eqNullSafe(F.col("doc_id")), "left")

    def make():
        def keep(ids, texts, drops):
            kept, lines, dropped = [], [], []
            for text, gone in zip(texts, drops):
                text = text or ""
                found = text.split("\n") if gone else None
                lines.append(len(found) if gone else text.count("\n") + 1)
                dropped.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    text = "\n".join([x for k, x in enumerate(found) if k not in gone])
                kept.append(text)
            return {"id": ids, "n_lines": lines, "n_dropped": dropped, "text": kept}

        return keep

    arrow = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])
    out = map_texts(met, ["_id", "_text", "drops"], make, "id long, n_lines long, n_dropped long, text string", arrow)
    return out.withColumnRenamed("id", id_col)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
split AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM rows),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}),
marked AS (
  SELECT r, doc_id, k, line, coalesce(keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper, false) AS gone
  FROM keyed LEFT JOIN common USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES = {"op11_line_dedup": ORACLE}
