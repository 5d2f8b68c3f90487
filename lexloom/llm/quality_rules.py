"""Operator 2: quality rules from a threshold table, in one Spark projection.

Each rule names a measure, a comparison and a bound; ``compile_rules`` turns the table into
one boolean column. Measures are built-in expressions over length, symbols, stop words and
lines, so nothing leaves the JVM and no row is shuffled.

Words are runs of anything but space, tab, LF, VT, FF and CR. Null and empty texts have no
words, all counts 0, ``base_failed`` true and ``kept`` false. Repeated rows give repeated
rows. Only the id and text columns are read, so other columns of any name are no matter.
Very long texts stay in their row: the cost is that of sorting their windows, and only where
hashes of the windows show that some window may repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import documents

SPACE = r"[\x20\x09-\x0D]+"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they "
    "le la les de des du un une et est que qui dans pour pas sur au aux ce se ne par plus "
    "der die das und ist von den dem ein eine zu mit auf für im nicht sich des als auch "
    "el los las en y por con del al una su para es no lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes while ``measure op bound`` holds."""

    name: str
    measure: str
    op: str
    bound: float


#: The production table. Ratios are per word or per line; bounds follow published web-text rules,
#: loosened where short or list-like clean texts would fail.
RULES = (
    Rule("enough_words", "n_words", ">=", 10),
    Rule("mean_word_not_short", "mean_word_chars", ">=", 2),
    Rule("mean_word_not_long", "mean_word_chars", "<=", 14),
    Rule("few_symbols", "symbols_per_word", "<=", 0.1),
    Rule("few_exclamations", "exclaimed_per_word", "<=", 0.4),
    Rule("letters_in_words", "lettered_per_word", ">=", 0.6),
    Rule("some_stop_words", "stops_per_word", ">=", 0.01),
    Rule("few_repeated_lines", "dup_lines_per_line", "<=", 0.5),
    Rule("few_bullets", "bullets_per_line", "<=", 0.9),
    Rule("few_ellipses", "ellipses_per_line", "<=", 0.5),
    Rule("few_repeated_words", "repeats_per_word", "<=", 0.2),
)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean column: whether every rule of the table holds."""
    ops = {">=": lambda c, b: c >= b, "<=": lambda c, b: c <= b, ">": lambda c, b: c > b, "<": lambda c, b: c < b}
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & ops[rule.op](F.col(rule.measure), F.lit(rule.bound))
    return verdict


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base counts and every measure that rules may name)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = lambda c: F.filter(F.split(c, SPACE), lambda w: w != "")
    out = df.select(F.col(id_col), text.alias("text")).select(
        id_col,
        "text",
        split(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("lines"),
    )
    shingles = F.transform(
        F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.xxhash64(F.slice("words", i, 5))
    )
    out = out.withColumn("n_words", F.size("words").cast("long")).withColumn(
        "hashes", F.when(F.col("n_words") > 5, shingles).otherwise(F.array().cast("array<bigint>"))
    )
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("words") - 4),
        lambda i: F.struct(F.array_join(F.slice("words", i, 5), " ").alias("w"), i.alias("i")),
    )
    out = out.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(pairs)),
    )
    # In sorted order a window repeats exactly if a neighbour equals it.
    places = F.array_sort(
        F.transform(
            F.filter(
                F.col("sorted"),
                lambda x, k: ((k > 0) & (F.get("sorted", k - 1)["w"] == x["w"]))
                | F.coalesce(F.get("sorted", k + 1)["w"] == x["w"], F.lit(False)),
            ),
            lambda x: x["i"],
        )
    )
    out = out.withColumn("places", F.coalesce(F.when(F.col("sorted").isNotNull(), places), F.array().cast("array<int>")))
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("places", k + 1) - p, F.lit(5)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    per_word = lambda c: F.when(F.col("n_words") > 0, c / F.col("n_words")).otherwise(F.lit(0.0))
    per_line = lambda c: F.when(F.size("lines") > 0, c / F.size("lines")).otherwise(F.lit(0.0))
    count = lambda array, test: F.size(F.filter(array, test))
    chars = F.length(F.regexp_replace("text", SPACE, "")).cast("long")
    symbols = (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long")
    out = out.select(
        id_col,
        "n_words",
        chars.alias("word_chars"),
        symbols.alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        per_word(chars).alias("mean_word_chars"),
        per_word(symbols).alias("symbols_per_word"),
        per_word(F.length("text") - F.length(F.translate("text", "!", ""))).alias("exclaimed_per_word"),
        per_word(count("words", lambda w: w.rlike(r"\p{L}"))).alias("lettered_per_word"),
        per_word(count("words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("stops_per_word"),
        per_line(F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup_lines_per_line"),
        per_line(count("lines", lambda x: x.rlike("^ *[-*•]"))).alias("bullets_per_line"),
        per_line(count("lines", lambda x: x.rlike(r"(\.\.\.|…) *$"))).alias("ellipses_per_line"),
        per_word(covered).alias("repeats_per_word"),
    )
    # A filter on the measures stays above this row of one struct; below it, each would be written out in
    # full as often as the steps before name it, and planning would not end.
    row = F.explode(F.array(F.struct(*[F.col(c) for c in out.columns if c != id_col]))).alias("row")
    return out.select(id_col, row).select(id_col, "row.*")


def apply_rules(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, base counts, base_failed, kept): the table's verdict on every document."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(df, id_col, text_col).select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & compile_rules(rules)).alias("kept"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir))


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_VERDICT = " AND ".join(f"{r.measure} {r.op} {r.bound}" for r in RULES)
ORACLE = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM split, unnest(range(1, len(words) - 3)) AS t(i)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM repeated, unnest(range(i, i + 5)) AS u(p) GROUP BY doc_id),
base AS (
  SELECT doc_id, text, words, lines, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id)),
measured AS (
  SELECT *,
         CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
         CASE WHEN n_words > 0 THEN (length(text) - length(translate(text, '!', ''))) / n_words ELSE 0 END AS exclaimed_per_word,
         CASE WHEN n_words > 0 THEN len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) / n_words ELSE 0 END AS lettered_per_word,
         CASE WHEN n_words > 0 THEN len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) / n_words ELSE 0 END AS stops_per_word,
         CASE WHEN len(lines) > 0 THEN n_dup_lines / len(lines) ELSE 0 END AS dup_lines_per_line,
         CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]'))) / len(lines) ELSE 0 END AS bullets_per_line,
         CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) / len(lines) ELSE 0 END AS ellipses_per_line,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeats_per_word,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {_VERDICT} AS kept
FROM measured
"""

QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": ORACLE}
