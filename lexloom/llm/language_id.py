"""Operator 10: language identification with error-correcting output codes.

Every learned language has a codeword of bits. One binary classifier per bit, over hashed
character n-grams of words, tells the languages whose bit is 1 from those whose bit is 0.
Decoding sums a logistic loss per bit, weighted by the bit's accuracy on the training sample,
and takes the codeword of least loss; a small gap to the second codeword marks the document
as ambiguous.

Up to seven languages get the exhaustive code (2**(k-1) - 1 bits), more get words drawn at
random, of which any two differ in a quarter of the bits or more. Training takes at most ``per_lang``
documents of each language, chosen by a hash of the id; executors send their n-gram counts, at most ``BUCKETS`` of
each document, and never texts to the driver. The model is one table of ``BUCKETS`` rows per bit. Whole texts are scored.

Null texts and texts without a letter give ``und`` with score 0. Without any labelled
document every text is ``und``. A single learned language is predicted for every text with a
letter. Repeated rows give repeated rows; ties go to the alphabetically first language.
Other columns are not read. Word scores are kept in a table of fixed size.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lexloom.llm.common import BROADCAST_IDS, Memo, documents, forget, map_texts

UNKNOWN = "und"
BUCKETS = 1 << 15
PER_LANG = 400
#: Gap of normalised loss below which a prediction is ambiguous.
MARGIN = 0.05


_PREDICTION = StructType(
    [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]
)


def word_grams(word: str) -> list[int]:
    """Hashed bigrams and trigrams of the word with both ends marked."""
    s = f"<{word}>"
    return [zlib.crc32(s[i : i + n].encode()) % BUCKETS for n in (2, 3) for i in range(len(s) - n + 1)]


def text_words(text: str) -> list[str]:
    """Lower-cased words of a text, without the signs around them."""
    return text.lower().split()


def code(k: int) -> np.ndarray:
    """A row of bits for each of k languages."""
    if k <= 7:
        bits = 2 ** max(k - 1, 1) - 1
        # Column b separates the languages by the binary digits of b; the first language always has 1.
        return np.array([[1] * bits] + [[(b >> i) & 1 for b in range(bits)] for i in range(k - 1)], np.int8)[:k]
    bits = 15 * int(np.ceil(np.log2(k)))
    while True:
        for seed in range(16):
            drawn = np.random.default_rng([k, bits, seed]).integers(0, 2, (k, bits)).astype(np.int8)
            signs = 2 * drawn.astype(np.int64) - 1
            apart = (bits - signs @ signs.T) // 2
            if apart[~np.eye(k, dtype=bool)].min() * 4 >= bits and 0 < drawn.sum(0).min() and drawn.sum(0).max() < k:
                return drawn
        bits += bits // 2


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray  # codewords, -1 or 1
    table: np.ndarray  # BUCKETS x bits
    bias: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def margin(self, total: np.ndarray) -> np.ndarray:
        return self.scale * (total[:-1] / max(total[-1], 1) - self.bias)

    def decode(self, margin: np.ndarray) -> tuple[str, float, bool]:
        """Language, share of belief and whether a second codeword is nearly as close."""
        loss = (np.logaddexp(0, -self.words * margin) * self.weight).sum(1) / self.weight.sum()
        belief = np.exp(-(loss - loss.min()) * 4 * len(self.weight))
        order = np.argsort(loss, kind="stable")
        near = len(order) > 1 and loss[order[1]] - loss[order[0]] < MARGIN
        return self.langs[order[0]], float(belief[order[0]] / belief.sum()), bool(near)


class WordScores:
    """Sums of classifier weights and n-gram counts by word: one row of a matrix for each word seen.

    The matrix has a fixed number of rows and starts anew when they are used up.
    """

    def __init__(self, table: np.ndarray, limit: int = 250_000):
        self.table, self.limit = table, limit
        self.rows = np.zeros((limit, table.shape[1] + 1))
        self.place = Memo(self._add, limit)

    def _add(self, word: str) -> int:
        grams, at = word_grams(word), len(self.place)
        row = self.rows[at]
        row[:-1] = self.table[grams].sum(0)
        row[-1] = len(grams)
        return at

    def total(self, text: str) -> np.ndarray:
        words = text_words(text)
        place, total = self.place, np.zeros(self.rows.shape[1])
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            if len(place) + len(part) > self.limit:  # never in the middle of a part
                place.clear()
            total += self.rows[list(map(place.__getitem__, part))].sum(0)
        return total


def gram_counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of each text."""
    memo, found = Memo(lambda word: np.array(word_grams(word), np.int32), 20_000), []
    for text in texts:
        grams = np.bincount(np.concatenate([np.empty(0, np.int32), *(memo[w] for w in text_words(text))]), minlength=1)
        found.append((np.flatnonzero(grams), grams[grams > 0]))
    return found


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Model | None:
    """A model from (n-grams, counts, language) of documents."""
    langs = sorted({lang for *_, lang in rows})
    if not langs:
        return None
    words = code(len(langs))
    shares = np.zeros((len(langs), BUCKETS))
    texts, of = [], []
    for grams, counts, lang in rows:
        if len(grams):
            # Square roots keep one long or repetitive document from setting a language's shares.
            shares[langs.index(lang), grams] += np.sqrt(counts)
            texts.append((grams, counts))
            of.append(langs.index(lang))
    shares = shares / np.maximum(shares.sum(1, keepdims=True), 1)
    table = np.zeros((BUCKETS, words.shape[1]))
    for b in range(words.shape[1]):
        one, none = words[:, b] == 1, words[:, b] == 0
        if one.any() and none.any():
            table[:, b] = np.log(shares[one].mean(0) + 1e-6) - np.log(shares[none].mean(0) + 1e-6)
    bits = words.shape[1]
    model = Model(langs, 2.0 * words - 1, table, np.zeros(bits), np.ones(bits), np.ones(bits))
    if texts:
        got, want = np.array([model.margin(np.append(c @ table[g], c.sum())) for g, c in texts]), model.words[of]
        for b in range(bits):
            up, down = got[want[:, b] > 0, b], got[want[:, b] < 0, b]
            if len(up) and len(down):
                model.bias[b] = (np.median(up) + np.median(down)) / 2
                model.scale[b] = 6 / max(np.median(up) - np.median(down), 1e-6)
        # A bit weighs as much as it is right beyond chance.
        right = ((got - model.bias) * want > 0).mean(0)
        model.weight = np.maximum(2 * right - 1, 1e-3)
    return model


def labelled_sample(df: DataFrame, per_lang: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """(n-grams, counts, language) of at most ``per_lang`` documents of each language.

    Ids of the least hashes are taken. All but about four times as many of a language as are wanted go by
    their hash alone; the rest are ranked, and the chosen ids (bounded by per_lang times languages)
    are broadcast to fetch the texts, which are counted where they are.
    """
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    named = rows.where("lang is not null and id is not null").select("id", "lang").distinct()
    share = (F.xxhash64("id").cast("double") + 2.0**63) / 2.0**64
    few = named.groupBy("lang").agg((F.lit(4.0 * per_lang + 100) / F.count("*")).alias("most"))
    few = F.broadcast(few) if few.count() <= BROADCAST_IDS else few
    ids = named.join(few, "lang").where(share <= F.col("most")).withColumn("r", rank).where(F.col("r") <= per_lang)
    chosen = rows.where("lang is not null and text is not null").join(F.broadcast(ids.select("id", "lang").distinct()), ["id", "lang"], "left_semi")
    # Of the rows of one id and language the smallest text, so that repeated ids do not swell the sample.
    chosen = chosen.groupBy("id", "lang").agg(F.min("text").alias("text"))

    def make():
        def f(ids, langs, texts):
            found = gram_counts(texts)
            return {"id": ids, "lang": langs, "grams": [x[0] for x in found], "counts": [x[1] for x in found]}

        return f

    arrow = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("grams", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    sent = map_texts(chosen, ["id", "lang", "text"], make, "id long, lang string, grams array<int>, counts array<int>", arrow)
    got = sorted((r["id"], r["lang"], r["grams"], r["counts"]) for r in sent.collect())
    return [(np.array(grams, np.int64), np.array(counts, np.int64), lang) for _, lang, grams, counts in got]


def train(
    df: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model | None:
    return fit(labelled_sample(df, per_lang, id_col, text_col, lang_col))


def _decider(model: Model | None):
    """A function from a text to (language, score, ambiguous)."""
    scores = WordScores(model.table) if model else None

    def one(text: str | None) -> tuple[str, float, bool]:
        if model is None or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        return model.decode(model.margin(scores.total(text)))

    return one


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous)."""

    def make():
        decide = _decider(model)

        def f(ids, texts):
            found = [decide(t) for t in texts]
            return {"id": ids} | {k: [x[i] for x in found] for i, k in enumerate(("lang_pred", "score", "ambiguous"))}

        return f

    arrow = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    out = map_texts(df, [id_col, text_col], make, "id long, lang_pred string, score double, ambiguous boolean", arrow)
    return out.withColumnRenamed("id", id_col)


def with_language(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows with all their columns and ``lang_pred``, ``score`` and ``ambiguous``, without a join.

    Columns of these three names are replaced.
    """
    own = [c for c in df.columns if c not in ("lang_pred", "score", "ambiguous")]
    base = df.select(*own)
    at = own.index(text_col)

    def run(batches):
        forget()
        decide = _decider(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                found = [decide(t) for t in part.column(at).to_pylist()]
                new = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*own, "lang_pred", "score", "ambiguous"])

    schema = StructType([*base.schema.fields, *_PREDICTION.fields])
    return base.mapInArrow(run, schema)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id's text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(remainder("doc_id", 4) != 2))
    return identify(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
