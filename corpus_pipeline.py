"""The training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. Part of the ``llm`` subpackage.

In every stage: columns are passed through by position, extra ones and clashing names
included; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.copies import copy_components, with_key
from ragloom.llm.packing import pack_documents
from ragloom.llm.quality import THRESHOLD as GOOD
from ragloom.llm.quality import with_quality
from ragloom.llm.shared import load, remove, shared_folder
from ragloom.llm.toxicity import THRESHOLD as TOXIC
from ragloom.llm.toxicity import with_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the grammar rejects go.

    A null or empty text matches no clause and stays; so does a null id, by its text.
    Equal texts, and so ties and repeated rows, go or stay together. Without labels the
    fixed lexicon and weights decide.
    """
    score = "_toxicity_of_stage"
    scored = with_toxicity(docs, load(spark, sf_dir, "labels"), score)
    return scored.where(F.col(score) < TOXIC).drop(score, f"{score}_clauses")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go.

    A null or empty text has the bias's score; a null id is judged by its text. Equal
    texts, and so ties and repeated rows, go or stay together. Without labels all
    scores are 0.5, and all documents stay.
    """
    score = "_quality_of_stage"
    return with_quality(docs, load(spark, sf_dir, "labels"), score).where(F.col(score) >= GOOD).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 at a wide budget: of each component of near copies (5-word shingles, Jaccard 0.8)
    one row stays; see ``ragloom.llm.copies``.

    Null, empty and blank texts are copies of each other. The row that stays is the one
    with the smallest id, null last; then with the smallest key of its text, then by its
    columns. Null and repeated ids are treated like others: a row goes or stays by its
    component alone, and of equal rows one stays.
    """
    key, component, row = "_key_of_stage", "_component_of_stage", "_row_of_stage"
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    text, own = (plain.columns[docs.columns.index(c)] for c in ("text", "doc_id"))
    parts = copy_components(plain, text).toDF(key, component)
    keyed = with_key(plain, text, key)
    # Rows that tie in all of this are equal in every column that can be compared.
    rest = [F.col(c) if c == text else F.to_json(F.struct(F.col(c))) for c in plain.columns]
    order = F.struct(F.col(own).isNull().alias("none"), F.col(own).alias("id"), F.col(key).alias("key"), F.xxhash64(*rest).alias("rest"))
    # Equal texts collapse first, so that a text with many copies is no large group of the join.
    whole = F.struct(*plain.columns)
    once = keyed.groupBy(key).agg(F.min_by(whole, order).alias(row), F.min(order).alias("least"))
    joined = once.join(parts, key, "left").withColumn(component, F.coalesce(component, key))
    kept = joined.groupBy(component).agg(F.min_by(row, "least").alias(row))
    return kept.select(*[F.col(f"{row}.{c}") for c in plain.columns]).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the kept documents, packed; see ``pack_documents`` for nulls and long texts."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("simhash", near_copies),
    ("packing", packing),
]

#: Trained models, near copies and packing aren't SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared folder.

    A stage's folder is deleted once the next one is written; packing keeps its pieces in a
    checkpoint, so the last folder goes before its rows are read.
    """
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)
    return out
