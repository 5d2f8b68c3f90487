"""Operator 6: mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output over its size. A
document's count is the inverse of the Poisson distribution with that mean at a uniform
number drawn from a hash of seed and id, so it is the same on every run and partitioning. The
document is exploded by its count and all copies are shuffled globally: each copy's place is
a hash, hashes are cut into shards, and shards are sorted.

Sizes are summed per source (pre-aggregated before the shuffle, so a hot source is no more
than one row per task) and the table of rates, one row per source, is broadcast while its
checked size is small, and joined by source and salt beyond that. Rates above ``STEP`` are drawn as a sum of equal smaller draws, which has
the same distribution; the series is followed until no 48-bit number is left, so no count is cut.

A null source is a source of its own. Null and empty texts have size 0 and share their
source's rate; a source without any size has rate 0 when sizes are texts' lengths. Documents
with equal ids share their counts. An empty table gives an empty result. Extra columns pass
through; the operator's own columns (``copy``, ``place``, ``shard``) replace any of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import documents, materialise

SEED = "mix-1"
#: Exponent of the production targets: a source's share goes with its size to this power.
TEMPERATURE = 0.5
#: Largest mean of a single draw and terms of its series: beyond them less than 2**-60 is left.
STEP, TERMS = 8.0, 48
SHARDS = 1024
#: Sources whose rates are broadcast; more of them are joined by source and salt.
BROADCAST_SOURCES, SALTS = 20_000, 64
BITS = 48


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 48 bits of MD5; exact as a double."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double") / float(2**BITS)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest count whose cumulative probability exceeds ``u``; means up to STEP."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), (F.exp(-mean) <= u).cast("int").alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        total = acc["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), (acc["n"] + (total <= u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["n"])


def rates(df: DataFrame, size: Column, source_col: str, weights: dict | None, temperature: float, budget: float) -> DataFrame:
    """(source key, mean): target share x budget x total size / the source's size."""
    by = df.groupBy(F.struct(F.col(source_col)).alias("_key")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        want = F.when(F.col("size") > 0, F.pow(F.col("size"), F.lit(temperature))).otherwise(F.lit(0.0))
    else:
        want = F.lit(0.0)
        for k, v in weights.items():
            want = F.when(F.col(f"_key.{source_col}").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(want)
    by = by.withColumn("want", want)
    whole = by.agg(F.sum("size").alias("total"), F.sum(F.when(F.col("size") > 0, F.col("want"))).alias("wants"))
    # One row, whatever the input.
    return by.join(F.broadcast(whole), F.lit(True)).select(
        "_key",
        F.when((F.col("size") > 0) & (F.col("wants") > 0), F.lit(float(budget)) * F.col("total") * F.col("want") / F.col("wants") / F.col("size"))
        .otherwise(F.lit(0.0))
        .alias("mean"),
    )


def mix(
    df: DataFrame,
    weights: dict | None = None,
    temperature: float = TEMPERATURE,
    budget: float = 1.0,
    seed: str = SEED,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All copies with ``copy`` (from 1), ``place`` (hash) and ``shard``; shuffled to shards and sorted by place.

    ``weights`` maps sources to target weights (others get 0); None means size ** temperature.
    ``budget`` is the size of the output as a multiple of the input.
    """
    own = [c for c in df.columns if c not in ("copy", "place", "shard")]
    base = df.select(*own)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    mean = materialise(rates(base, size, source_col, weights, temperature, budget))
    keyed = base.withColumn("_key", F.struct(F.col(source_col)))
    if mean.count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(mean), "_key", "left")
    else:  # a hot source is dealt to as many tasks as there are salts
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
        joined = salted.join(mean.withColumn("_salt", salts), ["_key", "_salt"], "left")
    draws = F.greatest(F.lit(1), F.ceil(F.col("mean") / STEP).cast("int"))
    count = F.aggregate(
        F.sequence(F.lit(1), draws),
        F.lit(0),
        lambda acc, i: acc + poisson_inverse(uniform(F.lit(seed), F.col(id_col), i), F.col("mean") / draws),
    )
    copies = joined.withColumn("_n", count).where("_n > 0").select(
        *own, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy")
    )
    placed = copies.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), F.col("copy").cast("string"))))
    shard = (F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * shards / F.lit(2**32)).cast("int")
    return placed.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "place")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE = f"""
WITH RECURSIVE by_source AS (
  SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS size FROM documents GROUP BY source),
wanted AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, {TEMPERATURE}) ELSE 0 END AS want FROM by_source),
rated AS (
  SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM wanted) * want / (SELECT sum(want) FROM wanted) / size ELSE 0 END AS mean
  FROM wanted),
drawn AS (
  SELECT d.*, mean / greatest(1, ceil(mean / {STEP})) AS m, unnest(range(1, greatest(1, ceil(mean / {STEP}))::INT + 1)) AS i
  FROM documents d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source),
seen AS (SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id || ':' || i), 1, {BITS // 4}))::UBIGINT::DOUBLE / {2**BITS}.0 AS u FROM drawn),
terms(m, k, p, total) AS (
  SELECT DISTINCT m, 0, exp(-m), exp(-m) FROM seen
  UNION ALL
  SELECT m, k + 1, p * m / (k + 1), total + p * m / (k + 1) FROM terms WHERE k < {TERMS}),
counted AS (
  SELECT s.doc_id, s.text, s.lang, s.source, s.n_chars, s.i, count(*) FILTER (WHERE t.total <= s.u) AS n
  FROM seen s JOIN terms t ON s.m = t.m GROUP BY ALL),
summed AS (SELECT doc_id, text, lang, source, n_chars, sum(n)::INT AS n FROM counted GROUP BY ALL),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM summed WHERE n > 0),
placed AS (SELECT *, md5('{SEED}:' || doc_id || ':' || copy) AS place FROM copies)
SELECT *, floor(('0x' || substr(place, 1, 8))::UBIGINT * {SHARDS} / {2**32}.0)::INT AS shard FROM placed
"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {"op6_mixing": ORACLE}
