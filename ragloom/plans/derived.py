"""A property graph derived from the star-schema tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions.lexicon import Lexicon
from ragloom.functions.ontology import Ontology, parse_relations
from ragloom.sources.readers import table

ONTOLOGY = Ontology(
    ("Region", "Nation", "Customer", "Supplier", "Order", "Part"),
    parse_relations("""
IN_REGION: Nation > Region: lies in
IN_NATION: Customer Supplier > Nation: is based in
PLACED: Customer > Order: ordered
CONTAINS: Order > Part: has a line of
SUPPLIES: Supplier > Part: delivered
"""),
)

#: Word lists that the synthetic texts hold, with keys that set off later ones.
LEXICON = Lexicon(
    stop=("and", "for", "that", "the", "this", "was", "with", "que", "und"),
    evidence=("tion", "ation", "thand", "heren", "ander"),
    conflict=("thth", "erst", "reth", "ndin"),
    alliance=("heit", "erst", "eran", "anth"),
    phrases=("of the", "in the", "to the"),
    expansions=(("ing", ("eran", "thin")), ("eran", ("ander", "stin")), ("stin", ("heit",)), ("que", ("mente", "ment")), ("ment", ("aux",)), ("zzz", ("never",))),
    flag_phrases={"asks_conflict": ("erst", "and the"), "asks_conspiracy": ("thand",), "asks_political": ("of the",), "asks_explanation": ("ation",), "asks_family": ("heren", "que"), "asks_hierarchy": ("ander",)},
    flag_cues={"asks_conflict": ("thth", "erst", "reth", "ndin"), "asks_conspiracy": ("thin", "ered"), "asks_political": ("anth", "onth"), "asks_explanation": ("tion", "ing"), "asks_family": ("que", "ment"), "asks_hierarchy": ("ander", "erha")},
)


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, name, type`` of all tables' rows."""
    parts = (("region", "r_regionkey", F.col("r_name"), "Region"), ("nation", "n_nationkey", F.col("n_name"), "Nation"), ("customer", "c_custkey", F.col("c_name"), "Customer"), ("supplier", "s_suppkey", F.col("s_name"), "Supplier"), ("orders", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "Order"), ("part", "p_partkey", F.col("p_name"), "Part"))
    out = None
    for name, key, label, kind in parts:
        rows = table(spark, sf_dir, name).select(_id(kind.lower(), key).alias("id"), label.alias("name"), F.lit(kind).alias("type"))
        out = rows if out is None else out.unionByName(rows)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id, relation, object_id, count``; lines of one order or supplier and part are one edge."""
    one = F.lit(1).cast("long").alias("count")
    read = lambda name: table(spark, sf_dir, name)
    keyed = lambda df, s, r, o: df.select(s.alias("subject_id"), F.lit(r).alias("relation"), o.alias("object_id"), one)
    lines = read("lineitem")
    counted = lambda s, r: lines.groupBy(s.alias("subject_id"), F.lit(r).alias("relation"), _id("part", "l_partkey").alias("object_id")).agg(F.count("*").alias("count"))
    return (
        keyed(read("nation"), _id("nation", "n_nationkey"), "IN_REGION", _id("region", "n_regionkey"))
        .unionByName(keyed(read("customer"), _id("customer", "c_custkey"), "IN_NATION", _id("nation", "c_nationkey")))
        .unionByName(keyed(read("supplier"), _id("supplier", "s_suppkey"), "IN_NATION", _id("nation", "s_nationkey")))
        .unionByName(keyed(read("orders"), _id("customer", "o_custkey"), "PLACED", _id("order", "o_orderkey")))
        .unionByName(counted(_id("order", "l_orderkey"), "CONTAINS"))
        .unionByName(counted(_id("supplier", "l_suppkey"), "SUPPLIES"))
    )


#: Kinds of nodes in the order of their numbers in ``links``.
KINDS = ("region", "nation", "customer", "supplier", "order", "part")


def number(kind: str, key):
    """A node's id in ``links``: its key and kind as one whole number; keys over 2 ** 60 are an error."""
    if isinstance(key, int):
        return key * 8 + KINDS.index(kind)
    whole = key.cast("long")
    held = F.when(whole.between(-(1 << 60), (1 << 60) - 1), whole * 8 + KINDS.index(kind))
    return F.when(whole.isNotNull(), F.coalesce(held, F.raise_error(F.lit("a key is too large")).cast("long")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id, object_id``: the ends of ``edges`` as numbers, repeats included, for searches that need no more."""
    ends = (("nation", ("nation", "n_nationkey"), ("region", "n_regionkey")), ("customer", ("customer", "c_custkey"), ("nation", "c_nationkey")), ("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey")), ("orders", ("customer", "o_custkey"), ("order", "o_orderkey")), ("lineitem", ("order", "l_orderkey"), ("part", "l_partkey")), ("lineitem", ("supplier", "l_suppkey"), ("part", "l_partkey")))
    out = None
    for name, (s, s_key), (o, o_key) in ends:
        rows = table(spark, sf_dir, name).select(number(s, F.col(s_key)).alias("subject_id"), number(o, F.col(o_key)).alias("object_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_mentions(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Nodes with ``mentions``: the counts of their edges."""
    ends = edges_.select(F.col("subject_id").alias("id"), "count").unionAll(edges_.select("object_id", "count"))
    return nodes_.join(ends.groupBy("id").agg(F.sum("count").alias("mentions")), "id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0).cast("long")))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id, relation, object_id`` between users of the events, with loops and cycles."""
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    other = F.concat(F.lit("user:"), (F.col("event_id") % 100).cast("string"))
    return table(spark, sf_dir, "events").select(user.alias("subject_id"), F.col("event_type").alias("relation"), other.alias("object_id")).distinct()


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' kept and returned parts as edges ``KEPT`` and ``RETURNED``."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    relation = F.when(F.col("l_returnflag") == "R", "RETURNED").otherwise("KEPT")
    return lines.select(_id("customer", "o_custkey").alias("subject_id"), relation.alias("relation"), _id("part", "l_partkey").alias("object_id")).distinct()
