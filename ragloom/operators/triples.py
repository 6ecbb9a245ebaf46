"""Typed triples: reply parsing, validation against the ontology, drop reasons, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import ontology as O
from ragloom.functions import text as T

TRIPLE = "struct<subject:string,subject_type:string,relation:string,object:string,object_type:string,description:string>"


def parse_reply(reply: Column, key: str, item: str) -> Column:
    """Items of a model's reply: a bare array, or the array under ``key``; bad JSON gives none."""
    text = T.strip_fence(reply)
    bare = F.from_json(text, f"array<{item}>")
    wrapped = F.from_json(text, f"struct<{key}:array<{item}>>")[key]
    none = F.array().cast(f"array<{item}>")
    items = F.when(text.startswith("["), bare).otherwise(wrapped)
    return F.filter(F.coalesce(items, none), lambda x: x.isNotNull())


def is_placeholder(name: Column) -> Column:
    return F.lower(T.compact_ends(name)).isin(O.PLACEHOLDERS.split("|"))


def is_proper_name(name: Column) -> Column:
    """Starts with a capital or digit, is no role word, no possessive or kinship description."""
    role = F.lower(T.compact_ends(name)).isin(O.GENERIC_ROLES.split())
    return name.rlike("^[A-Z0-9]") & ~role & ~name.rlike(r"'s\s+[a-z]") & ~name.rlike(O.DESCRIPTORS)


def validate(triples: DataFrame, ontology: O.Ontology = O.DEFAULT) -> DataFrame:
    """Trimmed triples with proper names, known types and an allowed relation; no description is empty."""
    names = {c: T.compact_ends(F.col(c)) for c in ("subject", "subject_type", "relation", "object", "object_type", "description")}
    rows = triples.withColumns(names)
    for c in ("subject", "object"):
        rows = rows.where((F.col(c) != "") & is_proper_name(F.col(c)) & ~is_placeholder(F.col(c)))
    allowed = F.broadcast(ontology.allowed(triples.sparkSession))  # the ontology's size, a few hundred rows
    return rows.join(allowed, ["relation", "subject_type", "object_type"], "left_semi")


def with_drop_reason(triples: DataFrame, nodes: DataFrame, ontology: O.Ontology = O.DEFAULT) -> DataFrame:
    """Adds ``drop_reason`` to triples with ids: unknown end, self-loop, wrong types, in that order.

    ``nodes`` has ``id, type``. Null where the triple stays; an unknown relation is
    dropped as ``unknown_relation``.
    """
    known = nodes.select("id", "type")
    s, o = known.toDF("subject_id", "_s"), known.toDF("object_id", "_o")
    allowed = F.broadcast(ontology.allowed(triples.sparkSession).toDF("relation", "_s", "_o").withColumn("_ok", F.lit(True)))
    rows = triples.join(s, "subject_id", "left").join(o, "object_id", "left").join(allowed, ["relation", "_s", "_o"], "left")
    names = [r.name for r in ontology.relations]
    reason = F.when(~F.col("relation").isin(names), "unknown_relation").when(F.col("_s").isNull() | F.col("_o").isNull(), "unknown_id").when(F.col("subject_id") == F.col("object_id"), "self_loop").when(F.col("_ok").isNull(), "type_violation")
    return rows.withColumn("drop_reason", reason).drop("_s", "_o", "_ok")


def summary(triples: DataFrame, most: int = 15) -> DataFrame:
    """Counts as ``what, key, n``: totals, distinct ends, and the relations used most."""
    total = triples.agg(F.count("*").alias("total"), F.countDistinct("subject_id").alias("subjects"), F.countDistinct("object_id").alias("objects"))
    parts = total.select(F.explode(F.array(*[F.struct(F.lit("total").alias("what"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in ("total", "subjects", "objects")])).alias("x")).select("x.*")
    relations = triples.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(most)
    return parts.unionByName(relations.select(F.lit("relation").alias("what"), F.col("relation").alias("key"), "n"))
