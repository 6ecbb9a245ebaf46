"""Sources: text lines, JSON lines, JSON documents, questions, vector stores, settings."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "document_id string, chunk_id string, title string, text string"
TRIPLES = "subject string, subject_type string, relation string, object string, object_type string, description string, document_id string, chunk_id string"
RESOLVED = "subject_id string, subject_name string, subject_type string, relation string, object_id string, object_name string, object_type string, description string, document_id string, chunk_id string"
ENTITY = "struct<id:string,canonical_name:string,type:string,aliases:array<string>,mentions:bigint>"
QUESTION = "struct<id:string,category:string,favors:string,question:string,graph_path:string,why_vector_struggles:string,why_graph_struggles:string>"
DECISION = "surface string, canonical string, type string, keep boolean"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables in a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``source, line_no, line`` of whole text files, without a byte-order mark."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return whole.select("source", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a known schema; blank lines drop out."""
    return spark.read.schema(schema).json(path)


def entities(spark: SparkSession, path: str, node_types) -> DataFrame:
    """Entities of known types from a JSON document with a list of them."""
    rows = spark.read.schema(f"count bigint, entities array<{ENTITY}>").json(path, multiLine=True).select(F.explode("entities").alias("e")).select("e.*")
    return rows.where(F.col("type").isin(list(node_types)))


def questions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Gold questions of a JSON document; without ``strict`` a missing or bad file gives none."""
    kind = f"questions array<{QUESTION}>"
    try:
        read = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("questions").alias("q")).select("q.*")
        rows = read.where(F.trim(F.coalesce("question", F.lit(""))) != "")
        if not strict:
            rows.limit(1).count()
        return rows
    except Exception:
        if strict:
            raise
        return spark.createDataFrame([], f"q {QUESTION}").select("q.*")


def vector_store(spark: SparkSession, path: str) -> DataFrame:
    """A vector store in Parquet; reading fails on a vector of a length that isn't ``dim``."""
    rows = spark.read.parquet(path)
    ok = F.size("embedding") == F.col("dim")
    return rows.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit("a vector's length is not dim")).cast("array<float>")))


def split_vector_store(spark: SparkSession, meta_path: str, matrix_path: str, dim: int, rows_a_record: int = 1) -> DataFrame:
    """Imports a store of a JSON list and a file of little-endian float32 rows, by position."""
    binary = spark.read.format("binaryFile").load(matrix_path).select("content")

    @F.pandas_udf("array<array<float>>")
    def rows(content):
        import numpy as np

        return content.map(lambda b: np.frombuffer(b, "<f4").reshape(-1, dim).tolist())

    vectors = binary.select(F.posexplode(rows("content")).alias("ord", "embedding"))
    meta = spark.read.schema("embedding_model string, dim int, count bigint, chunks array<struct<document_id:string,chunk_id:string,title:string,text:string,text_hash:string>>").json(meta_path, multiLine=True)
    chunks = meta.select("dim", F.posexplode("chunks").alias("ord", "c")).select("ord", "dim", "c.*")
    return chunks.join(vectors, "ord", "left").withColumn("embedding", F.coalesce("embedding", F.raise_error(F.lit("the store has fewer vectors than chunks")).cast("array<float>")))


def settings(path: str) -> dict[str, str]:
    """``KEY=value`` lines of a file; comments and quotes go, the environment wins."""
    out: dict[str, str] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, found, value = line.partition("=")
        if found and not line.lstrip().startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            out[key.strip()] = os.environ.get(key.strip(), value[1:-1] if quoted else value)
    return out
