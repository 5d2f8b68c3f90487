"""Operator 7: quality classifier from Naive Bayes support vectors.

A document is the set of its features, hashed, in two families. The first is its n-grams of one to ``GRAMS``
code points. The second is its n-grams of words in coarser alphabets: word ends, single shapes, pairs of
neighbouring shapes, and, as an n-gram's indicator does not tell a text that repeats itself, the shares of equal
neighbours and of fresh words. Each indicator is scaled by the log ratio of its share among good and bad documents
and by the size of its family in the document, and a linear model with hinge loss is fitted to the scaled
indicators by dual coordinate descent, then interpolated with the ratios' mean.

Training takes at most ``sample`` labelled documents chosen by a hash of the id; the model is
one table of ``BUCKETS`` weights. Whole texts are scored.

Null and empty texts have no features and score the model's bias. Without labels of both
kinds all scores are 0.5. Repeated rows give repeated rows; documents that are labelled more
than once learn from each label. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Memo, bounded_sample, documents, map_texts
from lexloom.llm.language_id import remainder

#: Buckets of one family, and code points of the longest n-gram.
FAMILY, GRAMS = 1 << 16, 3
BUCKETS = 2 * FAMILY
#: Code points of a text whose n-grams are hashed at once.
PIECE = 1 << 18
SAMPLE = 3000
#: Hinge-loss bound of the dual variables, epochs and the share of the fitted weights.
C, EPOCHS, BETA = 1.0, 12, 0.5

_LOWER = re.compile(r"[^\W\d_A-Z]+")
_UPPER = re.compile(r"[A-Z]+")
_DIGIT = re.compile(r"\d+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> str:
    """Runs of lower-case letters, capitals and digits as one sign each; other signs stay."""
    return _UPPER.sub("X", _DIGIT.sub("9", _LOWER.sub("x", word)))


def _bucket(text: str) -> int:
    return FAMILY + zlib.crc32(text.encode("utf-8", "surrogatepass")) % FAMILY


def grams(text: str, longest: int = GRAMS) -> np.ndarray:
    """The buckets of the n-grams of one to ``longest`` code points, in pieces that overlap by an n-gram."""
    seen = np.zeros(FAMILY, bool)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        made = np.zeros(len(points), np.uint64)
        for n in range(1, min(longest, len(points)) + 1):
            made = (made[: len(points) - n + 1] ^ points[n - 1 :]) * _MIX
            made ^= made >> np.uint64(29)
            seen[(made >> np.uint64(20)) % np.uint64(FAMILY)] = True
    return np.flatnonzero(seen)


class Features:
    """The feature sets of texts; word tables are of fixed size."""

    def __init__(self):
        self.words = Memo(self._word, 200_000)
        self.looks: dict[str, tuple[str, int]] = Memo(lambda look: (look, _bucket("s:" + look)), 50_000)
        self.pairs = Memo(lambda p: _bucket(f"p:{p[0]}|{p[1]}"), 50_000)

    def _word(self, word: str) -> tuple[str, int, int]:
        look, bucket = self.looks[shape(word)]
        return look, bucket, _bucket("e:" + word[-3:].lower())

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of a text's features, and the scale of each: a family counts alike however many it has."""
        return scaled(self.families(text))

    def families(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return grams(text), self.forms(text)

    def forms(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.empty(0, np.int64)
        made = list(map(self.words.__getitem__, words))
        looks = [x[0] for x in made]
        found = {x[1] for x in made} | {x[2] for x in made}
        found.update(map(self.pairs.__getitem__, set(zip(looks, looks[1:]))))
        same = sum(map(str.__eq__, words, words[1:]))
        if same:
            found.add(_bucket(f"same:{min(9, 10 * same // len(words))}"))
        fresh = len(set(words)) / len(words)
        found.add(_bucket(f"fresh:{int(10 * fresh)}:{min(4, len(words) // 50)}"))
        return np.fromiter(found, np.int64, len(found))


def scaled(families: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(families), np.concatenate([np.full(len(f), 1 / np.sqrt(max(len(f), 1))) for f in families])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray, scale: np.ndarray) -> float:
        margin = self.weights[features] @ scale + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Smoothed log of each feature's share among good over its share among bad documents."""
    counts = np.ones((2, BUCKETS))
    for features, y in zip(rows, labels, strict=True):
        counts[int(y), features] += 1
    shares = counts / counts.sum(1, keepdims=True)
    return np.log(shares[1]) - np.log(shares[0])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, bound: np.ndarray, epochs: int):
    """Weights and bias of the hinge-loss model: one dual variable per document, in [0, bound]."""
    w, b = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, x, v = labels[i], rows[i], values[i]
            gradient = y * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), bound[i])
            if new != alpha[i]:
                w[x] += (step := (new - alpha[i]) * y) * v
                b += step
                alpha[i] = new
    return w, b


def fit(families: list[tuple[np.ndarray, np.ndarray]], labels: list[int], c: float = C, epochs: int = EPOCHS, beta: float = BETA) -> Model:
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 0.0)
    made = [scaled(f) for f in families]
    rows = [x for x, _ in made]
    ratio = log_ratios(rows, y)
    values = [ratio[x] * scale for x, scale in made]
    # Both classes pull alike, however rare one is.
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, b = dual_descent(rows, values, np.where(y == 1, 1.0, -1.0), c * share, epochs)
    mean = np.abs(w).mean()
    weights = ratio * ((1 - beta) * mean + beta * w)
    raw = np.array([weights[x] @ scale for x, scale in made]) + beta * b
    slope, offset = 1.0, 0.0
    prior = np.log(y.sum() / (len(y) - y.sum()))
    spread = max(raw.std(), 1e-9)
    slope, offset = 1 / spread, prior * 0.5
    for _ in range(200):  # logistic calibration of the margins
        p = 1 / (1 + np.exp(-np.clip(slope * raw + offset, -30, 30)))
        error = p - y
        slope -= 0.5 * (error * raw).mean() / spread**2
        offset -= 0.5 * error.mean() * 4
    return Model(weights, beta * b, slope, offset)


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    chosen = bounded_sample(known, sample, "id")
    # At most ``sample`` ids, one row each: small enough to broadcast, at any size of the corpus.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Of the rows of one id the smallest text. Buckets and not texts reach the driver: a bounded number a document.
    pairs = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def make():
        features = Features()

        def f(ids, ys, texts):
            found = [features.families(t) for t in texts]
            return {"id": ids, "y": ys, "grams": [x[0] for x in found], "forms": [x[1] for x in found]}

        return f

    arrow = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("grams", pa.list_(pa.int32())), ("forms", pa.list_(pa.int32()))])
    sent = map_texts(pairs, ["id", "y", "text"], make, "id long, y int, grams array<int>, forms array<int>", arrow)
    got = sorted((r["id"], r["y"], r["grams"], r["forms"]) for r in sent.collect())
    return fit([(np.array(g, np.int64), np.array(f, np.int64)) for _, _, g, f in got], [y for _, y, _, _ in got])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the higher, the likelier good."""

    def make():
        features = Features()
        return lambda ids, texts: {"id": ids, "score": [model.score(*features.of(t or "")) for t in texts]}

    arrow = pa.schema([("id", pa.int64()), ("score", pa.float64())])
    return map_texts(df, [id_col, text_col], make, "id long, score double", arrow).withColumnRenamed("id", id_col)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(remainder("doc_id", 3) != 1))
    return score(docs, model).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLES: dict[str, str] = {}
