"""Entry sources: line-delimited JSON, plain, gzip or zstd."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORM = "struct<form:string,tags:array<string>,source:string,links:array<array<string>>,raw_tags:array<string>,roman:string,ruby:array<array<string>>>"
_OF = "array<struct<word:string,extra:string>>"
_SENSE = (
    f"struct<form_of:{_OF},alt_of:{_OF},tags:array<string>,categories:array<string>,glosses:array<string>,examples:array<string>,"
    "links:array<array<string>>,topics:array<string>,raw_glosses:array<string>,qualifier:string,synonyms:array<string>,"
    "antonyms:array<string>,raw_tags:array<string>>"
)
_TEMPLATE = "array<struct<name:string,args:map<string,string>,expansion:string>>"
#: Unknown fields are ignored; string-or-object fields keep their JSON text.
ENTRY = (
    f"pos string, lang_code string, lang string, word string, source string, etymology_text string, redirects array<string>, "
    f"forms array<{_FORM}>, senses array<{_SENSE}>, head_templates {_TEMPLATE}, inflection_templates {_TEMPLATE}, "
    f"etymology_templates {_TEMPLATE}, categories array<string>, sounds array<string>, synonyms array<string>, "
    "antonyms array<string>, related array<string>, derived array<string>"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, src_ord) of non-blank lines; codecs follow the file names.

    ``src_ord`` grows with the place in the source and is fixed at ingest, so first-wins operators
    need no row order later.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("src_ord"))
    return lines.where(F.trim("value") != "")


def parse_entries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, quarantine): redirects and thesaurus rows are skipped; rows without a required field are set apart.

    The cheap fields are read before the whole record, so skipped rows are never decoded in full.
    """
    pos, source = F.get_json_object("value", "$.pos"), F.get_json_object("value", "$.source")
    redirect = F.get_json_object("value", "$.redirect").isNotNull()
    kept = lines.where(~redirect & ~(pos.isNull() & F.coalesce(source == "thesaurus", F.lit(False))))
    parsed = kept.withColumn("entry", F.from_json("value", ENTRY))
    complete = F.lit(True)
    for field in ("pos", "lang_code", "lang", "word"):
        complete = complete & F.col(f"entry.{field}").isNotNull()
    good = parsed.where(complete).select("src_ord", "entry.*")
    return good, parsed.where(~complete | F.col("entry").isNull()).select("src_ord", "file", "value")


def language_counts(df: DataFrame, wanted: DataFrame, lang: str) -> DataFrame:
    """(lang, n) of each wanted language, with 0 where the source has none."""
    counts = df.groupBy(lang).agg(F.count("*").alias("n"))
    return wanted.join(counts, lang, "left").select(lang, F.coalesce("n", F.lit(0)).alias("n"))


def split_languages(df: DataFrame, wanted: DataFrame, path: str, lang: str = "lang_code") -> None:
    """One pass to a Parquet folder per language; fails before writing if a wanted language is empty."""
    empty = [r[lang] for r in language_counts(df, wanted, lang).where("n = 0").collect()]
    if empty:
        raise ValueError(f"no rows for {', '.join(sorted(empty))}")
    df.join(F.broadcast(wanted), lang, "left_semi").write.mode("overwrite").partitionBy(lang).parquet(path)


def installed_version(versions: DataFrame, current: str) -> DataFrame:
    """Per language the current hash if it is installed, else the newest."""
    order = F.struct((F.col("hash") == current), F.col("installed_at"), F.col("hash"))
    return versions.groupBy("lang").agg(F.max_by("hash", order).alias("hash"))
