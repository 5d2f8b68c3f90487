"""Operator 9: BPE encoding and decoding by per-prefix dynamic programming (see ``bpe``).

``encode`` gives the ids of each text, ``decode`` the text of each list of ids, and
``encode_digest`` the token count with SHA-256 of ids and of the decoded text.

Null texts encode as empty; empty texts have no ids and decode to the empty string; null id
lists decode to the empty string. Special strings inside a text become their own ids, as the
library does by default. Other columns are not read. Memory holds one Arrow batch and word
tables of a fixed size.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.bpe import encoder
from lexloom.llm.common import documents, map_texts


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>)."""

    def make():
        e = encoder(path)
        return lambda ids, texts: {"id": ids, "ids": [e.encode(t or "") for t in texts]}

    arrow = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return map_texts(df, [id_col, text_col], make, "id long, ids array<int>", arrow, path).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded string)."""

    def make():
        e = encoder(path)
        return lambda ids, lists: {"id": ids, "decoded": [e.decode(x or []) for x in lists]}

    arrow = pa.schema([("id", pa.int64()), ("decoded", pa.string())])
    return map_texts(df, [id_col, ids_col], make, "id long, decoded string", arrow, path).withColumnRenamed("id", id_col)


def encode_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256)."""

    def make():
        e = encoder(path)

        def f(ids, texts):
            found = [e.digest(t or "") for t in texts]
            return {"id": ids} | {k: [x[i] for x in found] for i, k in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

        return f

    arrow = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    out = map_texts(df, [id_col, text_col], make, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", arrow, path)
    return out.withColumnRenamed("id", id_col)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_bpe_codec": op9_bpe_codec}
ORACLES: dict[str, str] = {}
