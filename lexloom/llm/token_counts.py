"""Operator 1: exact token counts at every prefix.

``token_prefix_counts`` keeps, for each text, the end of every pre-token and the number of
tokens up to it. ``within_budget`` and ``truncation_point`` answer budget and truncation
questions from those arrays alone, inside Spark and without encoding again.

Null texts count as empty; an empty text has empty arrays and no tokens. Repeated rows give
repeated rows. Only the id and text columns are read, so other columns of any name are no
matter. Ends are code points of the normalised text (NFC, lower case), which is what the
vocabulary sees. Memory holds one Arrow batch and word tables of a fixed size.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.bpe import encoder
from lexloom.llm.common import documents, map_texts

#: Tokens that a context of the production models holds.
LIMIT = 2048


def token_prefix_counts(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", inside: bool = False
) -> DataFrame:
    """(id, ends array<int>, counts array<int>): tokens up to the end of every pre-token.

    With ``inside``, also up to every code point of a pre-token, so very long ones can be cut as well.
    """

    def make():
        e = encoder(path)

        def f(ids, texts):
            found = [e.prefix_counts(t or "", inside) for t in texts]
            return {"id": ids, "ends": [x[0] for x in found], "counts": [x[1] for x in found]}

        return f

    arrow = pa.schema([("id", pa.int64()), ("ends", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    out = map_texts(df, [id_col, text_col], make, "id long, ends array<int>, counts array<int>", arrow, path)
    return out.withColumnRenamed("id", id_col)


def truncation_point(ends: Column, counts: Column, budget: int) -> Column:
    """The end of the longest run of whole pre-tokens from the start that needs at most ``budget`` tokens; 0 if none."""
    fitting = F.size(F.filter(counts, lambda c: c <= budget))
    return F.when(fitting > 0, F.element_at(ends, fitting)).otherwise(F.lit(0))


def within_budget(counts: Column, budget: int) -> Column:
    """Whether the whole text needs at most ``budget`` tokens."""
    return F.when(F.size(counts) > 0, F.element_at(counts, -1) <= budget).otherwise(F.lit(budget >= 0))


def token_totals(
    df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): the last entry of each text's prefix table.

    Pre-tokens are encoded apart, so that entry is the sum of the last entries of their prefix tables;
    the arrays of long texts are never built.
    """

    def make():
        e = encoder(path)

        def f(ids, texts):
            texts = [t or "" for t in texts]
            counts = [e.count(t) for t in texts]
            return {
                "id": ids,
                "n_bytes": [len(t) if t.isascii() else len(t.encode()) for t in texts],
                "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
            }

        return f

    arrow = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    out = map_texts(df, [id_col, text_col], make, "id long, n_bytes long, n_tokens long, over_limit boolean", arrow, path)
    return out.withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_totals(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
