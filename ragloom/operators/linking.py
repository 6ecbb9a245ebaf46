"""Entity linking by full-text search: an inverted index with BM25 scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T

#: BM25's usual parameters.
K1, B = 1.2, 0.75


def tokens(rows: DataFrame, key: str, text) -> DataFrame:
    """``key, token`` for every token of a text, repeats included."""
    return rows.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))


def index(entities: DataFrame) -> DataFrame:
    """``token, id, score``: what a mention's token adds to an entity (``id, name, aliases``)."""
    text = F.concat_ws(" ", "name", F.array_join("aliases", " "))
    found = tokens(entities.withColumn("_text", text), "id", F.col("_text")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    lengths = found.groupBy("id").agg(F.sum("tf").alias("length"))
    whole = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    rows = found.join(lengths, "id").join(df, "token").join(F.broadcast(whole))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.select("token", "id", score.alias("score"))


def link(mentions: DataFrame, inverted: DataFrame) -> DataFrame:
    """``mention, id, score``: the best entity of each mention, the smallest id of equals."""
    asked = tokens(mentions.withColumn("_text", T.lucene_escape(F.col("mention"))).where("_text != ''"), "mention", F.col("_text")).distinct()
    scored = asked.join(inverted, "token").groupBy("mention", "id").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("mention").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def first_of_each(linked: DataFrame, order: str) -> DataFrame:
    """The first mention, by ``order``, of each entity."""
    w = Window.partitionBy("id").orderBy(order)
    return linked.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
