"""Operator 4: secret scans with character Markov models, in DataFrame functions only.

Three base patterns find assignments, access keys and long hex strings. Beyond them, every
long run of key characters is scored by two bigram models of characters, one of random
strings and one of ordinary identifiers; a run whose mean log-likelihood ratio exceeds the
threshold is a span of kind ``markov``. Runs are cut at base spans, and what is left of them is scored by itself.

The models are trained from labelled samples: random strings are values that the base
patterns matched in a bounded sample of documents and digests drawn by a rule; ordinary
identifiers are that sample's other runs. Counts of character pairs are added up by Spark;
at most ``2 * 69 ** 2`` sums reach the driver, whatever the input.

Null texts count as empty; empty texts have no spans and the digest of the empty string.
Repeated rows give repeated rows. Only id and text are read, so other columns of any name are
no matter. An empty table gives an empty table: the models then rest on digests and smoothing.
Offsets are code points, end exclusive. Very long texts stay in one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import bounded_sample, documents

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
#: Characters of a run, and of a piece of one, at least.
LEAST = 16

#: Characters of the models; 0 stands for both ends of a run.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
SIZE = len(ALPHABET) + 1

#: Documents that the ordinary model is fitted on, at most.
SAMPLE = 2000
#: Mean log-likelihood ratio per transition from which a run counts as random.
THRESHOLD = 0.8

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
KINDS = ("assign", "access", "hex", "markov")


def _found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches, from the lengths of matches and of what lies between.

    Texts without a match take the short way out after one search.
    """
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["before"])
        last = first + F.length(x["whole"])
        span = F.struct(first.alias("start"), F.lit(kind).alias("kind"), last.alias("end"), x["kept"].alias("value"))
        fits = F.length(x["kept"]) >= least
        return F.struct(last.alias("at"), F.when(fits, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zipped = F.arrays_zip(
        F.slice(between, F.lit(1), F.size(whole)).alias("before"), whole.alias("whole"), kept.alias("kept")
    )
    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda acc: acc["spans"])).otherwise(
        F.array().cast(SPAN)
    )


def base_spans(text: Column) -> Column:
    """All base spans in order of start, then of kind."""
    return F.array_sort(
        F.concat(_found(text, ASSIGN, 0, 2, 8), _found(text, ACCESS, 1), _found(text, HEX, 2))
    )


def _apart(spans: Column, base: Column) -> Column:
    """The spans that touch no base span."""
    return F.filter(
        spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )


def _pieces(spans: Column, base: Column, least: int) -> Column:
    """What base spans, which come in order of start, leave of the spans, if it has ``least`` characters."""

    def cut(s: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            value = F.substring(s["value"], start - s["start"] + 1, end - start)
            return F.struct(start.alias("start"), s["kind"].alias("kind"), end.alias("end"), value.alias("value"))

        def step(acc: Column, b: Column) -> Column:
            last = F.greatest(acc["at"], b["end"])
            kept = F.when(b["start"] - acc["at"] >= least, F.array_append(acc["out"], piece(acc["at"], b["start"]))).otherwise(acc["out"])
            return F.struct(last.alias("at"), kept.alias("out"))

        touching = F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        start = F.struct(s["start"].alias("at"), F.array().cast(SPAN).alias("out"))
        rest = lambda acc: F.when(s["end"] - acc["at"] >= least, F.array_append(acc["out"], piece(acc["at"], s["end"]))).otherwise(acc["out"])
        return F.aggregate(touching, start, step, rest)

    return F.when(F.size(base) > 0, F.flatten(F.transform(spans, cut))).otherwise(spans)


def _pairs(run: Column) -> Column:
    """The run's transitions as numbers below SIZE squared, with both ends."""
    at = lambda i: F.position(F.substring(run, i, F.lit(1)), F.lit(ALPHABET))
    inner = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: at(i) * SIZE + at(i + 1))
    return F.concat(F.array(at(F.lit(1))), inner, F.array(at(F.length(run)) * SIZE))


def train(df: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The log-likelihood ratio of every transition, random over ordinary, in nats."""
    rows = bounded_sample(df.select(id_col, text_col), sample, id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = rows.select(base_spans(text).alias("base"), _found(text, RUN.replace("16", "6"), 3).alias("runs"))
    real = spans.select(F.explode("base").alias("s")).select(F.lit(1).alias("random"), F.col("s.value").alias("run"))
    plain = spans.select(F.explode(_apart(F.col("runs"), F.col("base"))).alias("s")).select(
        F.lit(0).alias("random"), F.col("s.value").alias("run")
    )
    digest = F.sha2(F.col("id").cast("string"), 256)
    drawn = df.sparkSession.range(0, 3000, 1, 2).select(
        F.lit(1).alias("random"),
        F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40))
        .when(F.col("id") % 3 == 1, F.rtrim(F.lit("="), F.base64(F.unhex(digest))))
        .otherwise(F.translate(F.base64(F.unhex(digest)), "+/=", ""))
        .alias("run"),
    )
    sums = (
        real.union(plain)
        .union(drawn)
        .where(F.length("run") >= 6)
        .select("random", F.explode(_pairs(F.col("run"))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )
    counts = [[0.0] * SIZE**2 for _ in range(2)]
    for r in sums:
        counts[r["random"]][r["pair"]] += r["count"]
    logs = []
    for each in counts:
        total = []
        for a in range(SIZE):
            row = each[a * SIZE : (a + 1) * SIZE]
            whole = sum(row) + 0.5 * SIZE
            total += [math.log((n + 0.5) / whole) for n in row]
        logs.append(total)
    return [x - y for x, y in zip(logs[1], logs[0], strict=True)]


def ratio(run: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of the run's transitions."""
    # A constant array, folded once at planning.
    scores = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    pairs = _pairs(run)
    return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.element_at(scores, p + 1)) / F.size(pairs)


def find_secrets(
    df: DataFrame,
    table: list[float],
    threshold: float = THRESHOLD,
    text_col: str = "text",
) -> DataFrame:
    """The rows with ``base`` and ``spans``: arrays of (start, kind, end, value)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = _found(text, RUN, 3)
    out = df.withColumn("base", base_spans(text)).withColumn("runs", runs)
    random = F.filter(_pieces(F.col("runs"), F.col("base"), LEAST), lambda s: ratio(s["value"], table) > threshold)
    return out.withColumn("spans", F.when(F.size("runs") > 0, F.array_sort(F.concat("base", random))).otherwise(F.col("base"))).drop("runs")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    joined = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan_digest(df: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans)."""
    found = find_secrets(df.select(F.col(id_col), F.col(text_col).alias("text")), table, text_col="text")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_shown(F.col("base")), 256).alias("base_sha256"),
        _shown(F.col("spans")).alias("spans"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan_digest(docs, train(docs))


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLES: dict[str, str] = {}
