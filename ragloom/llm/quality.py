"""Operator 9: a quality classifier of hashed word n-grams.

Logistic regression with follow-the-regularised-leader (FTRL-proximal) updates; a
document's score is a sparse dot product of its n-gram frequencies with the weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.bpe import Recent
from ragloom.llm.shared import append_columns, first_by_hash, load, small_batches

#: Weights of hashed word n-grams, a power of two; after them come those of shape n-grams.
BUCKETS = 1 << 18
#: Labelled rows that training takes at most, the first in the order of a hash of the id, and
#: the characters that their texts may have together (a text that would go beyond is left out).
TRAIN_ROWS, TRAIN_CHARS = 8000, 1 << 27
#: Passes over them, and FTRL's learning rate, its offset, and L1 and L2 strengths.
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 0.02, 0.1
#: A document is kept from this score on.
THRESHOLD = 0.3
#: One fold of this many is held out.
FOLDS = 5

TOKEN = re.compile(r"\w+|[^\w\s]")
#: Shapes of tokens: punctuation has one of 16 by its code, words by length and case.
SAME, SHAPES = 31, 32
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def token_code(token: str) -> int:
    """A token's 64-bit hash, whose five lowest bits are its shape."""
    if not (token[0].isalnum() or token[0] == "_"):
        shape = 15 + ord(token) % 16
    elif token[0].isdigit():
        shape = 14
    else:
        shape = (7 if token[0].isupper() else 0) + min(6, len(token) // 3)
    return xxhash.xxh64_intdigest(token.lower().encode("utf-8", "replace")) & ~31 | shape


class Features:
    """Turns texts into feature positions; every position has the same value, see ``scale``."""

    def __init__(self):
        self.codes = Recent(token_code)

    def __call__(self, text: str | None) -> np.ndarray:
        """Positions of the text's n-grams, repeats included: words, word pairs, shape triples."""
        tokens = TOKEN.findall(text or "")
        n = len(tokens)
        codes = self.codes
        w = np.fromiter([codes[t] for t in tokens], np.uint64, n)
        shape = (w & np.uint64(31)).astype(np.int64)
        word = shape < 15
        shape[1:][w[1:] == w[:-1]] = SAME
        shape[2:][(w[2:] == w[:-2]) & word[2:]] = SAME  # repeated with a comma between
        shift = np.uint64(64 - BUCKETS.bit_length() + 1)
        one = (w * _ODD[0]) >> shift
        two = (w[:-1] * _ODD[0] + w[1:] * _ODD[1]) >> shift
        three = (shape[:-2] * SHAPES + shape[1:-1]) * SHAPES + shape[2:] + BUCKETS
        return np.concatenate([one.astype(np.int64), two.astype(np.int64), three])


def scale(n: int) -> float:
    """The value of each of a text's ``n`` positions: what they add up to is the same for all texts."""
    return 8.0 / max(n, 1)


class Ftrl:
    """FTRL-proximal logistic regression over sparse rows; the last weight is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One update from a row with distinct positions ``at``, values ``x`` and label ``y``."""
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x)))))
        g = (p - y) * x
        root = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (root - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def train(texts: list[str | None], labels: list[int]) -> np.ndarray:
    """Weights for positions, the bias last. Without rows all weights are zero."""
    size = BUCKETS + SHAPES**3
    model, features = Ftrl(size), Features()
    rows = []
    for text in texts:
        at = features(text)
        own, counts = np.unique(at, return_counts=True)
        rows.append((np.r_[own, size], np.r_[counts * scale(len(at)), 1.0]))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i], labels[i])
    return model.weights(slice(None)).astype(np.float32)


def score(features: Features, weights: np.ndarray, text: str | None) -> float:
    """Probability of label 1; an empty text has the bias alone."""
    at = features(text)
    dot = float(weights[-1]) + float(weights[at].sum(dtype=np.float64)) * scale(len(at))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, dot))))


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held: int, folds: int, rows: int, id_col: str = "doc_id", text_col: str = "text", chars: int = TRAIN_CHARS) -> DataFrame:
    """``_id, text, label`` of at most ``rows`` labelled documents that aren't in fold ``held``.

    They are the first in the order of a hash of the id. Null labels and ids drop out;
    of contradictory labels of one id the larger counts; of several texts of one id the
    one of the smallest hash, so that an id is a row however often it is repeated. Rows
    whose texts, in that order, go beyond ``chars`` characters in all are left out.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held))
    own = first_by_hash(own.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label")), "_id", rows)
    own = F.broadcast(own)  # ``rows`` of them at most
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(own, "_id")
    order = F.struct(F.xxhash64("text"), F.coalesce("text", F.lit("")))
    once = found.groupBy("_id").agg(F.min_by("text", order).alias("text"), F.max("_label").alias("label"))
    before = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)  # over ``rows`` rows at most
    sized = once.withColumn("_chars", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(before))
    return sized.where(F.col("_chars") <= chars).select("_id", "text", "label")


def learn_weights(sample: DataFrame) -> np.ndarray:
    """The weights that one task learns from ``_id, text, label`` rows, in the order of their ids."""
    kind = "weights binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["_id"], r["text"], r["label"]) for b in batches for r in b.to_pylist()), key=lambda r: (r[0], r[1] or ""))
        weights = train([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    row = sample.repartition(1).mapInArrow(run, kind).first()
    return np.frombuffer(bytes(row["weights"]), np.float32) if row else train([], [])


def with_quality(docs: DataFrame, labels: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", held: int = 0, folds: int = FOLDS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with the score as column ``out``; see ``score_quality``."""
    spark = docs.sparkSession
    small_batches(spark)
    weights = spark.sparkContext.broadcast(learn_weights(training_rows(docs, labels, label, held, folds, train_rows, id_col, text_col)))  # of fixed size

    def make():
        features, w = Features(), weights.value
        return lambda texts: [pa.array([score(features, w, v.as_py()) for v in texts], pa.float64())]

    return append_columns(docs, text_col, make, f"`{out}` double")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", held: int = 0, folds: int = FOLDS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id, held_out, score, predicted`` of every whole document.

    Learns from at most ``train_rows`` labelled documents of the other folds. A null or
    empty text gets the bias's score; very long texts are read whole; a null id is
    scored, in fold 0; repeated rows each give a row; with no labelled row all scores
    are 0.5; an empty table gives no rows. Extra columns are left out.
    """
    scored = with_quality(docs.select(id_col, text_col), labels, "score", id_col, text_col, label, held, folds, train_rows)
    return scored.select(id_col, (fold(id_col, folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
