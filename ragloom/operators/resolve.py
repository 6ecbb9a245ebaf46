"""Entity resolution: mentions, votes, decisions, entities, merges, rewritten triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import ontology as O
from ragloom.functions import text as T
from ragloom.operators.components import connected_components
from ragloom.operators.triples import is_placeholder


def mentions(rows: DataFrame, ontology: O.Ontology | None = O.DEFAULT) -> DataFrame:
    """``surface, count, first, type`` of rows ``ord, surface, type``: the type named most,
    the first seen of equals; types outside the ontology have no vote."""
    votes = rows.groupBy("surface", "type").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    ok = F.col("type").isin(list(ontology.node_types)) if ontology else F.lit(True)
    kind = F.min_by(F.when(ok, F.col("type")), F.when(ok, F.struct((-F.col("n")).alias("n"), "first")))
    default = ontology.node_types[0] if ontology else None
    return votes.groupBy("surface").agg(F.sum("n").alias("count"), F.min("first").alias("first"), F.coalesce(kind, F.lit(default)).alias("type"))


def both_ends(triples: DataFrame) -> DataFrame:
    """Mentions of triples as ``ord, surface, type``, subject before object."""
    end = lambda name, place: F.struct(F.struct("ord", F.lit(place).alias("place")).alias("ord"), F.col(name).alias("surface"), F.col(f"{name}_type").alias("type"))
    ends = F.array(end("subject", 0), end("object", 1))
    return triples.select(F.explode(ends).alias("x")).select("x.*")


def decide(found: DataFrame, decisions: DataFrame | None = None, overrides: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Adds ``canonical, kind, keep``: an override, else the decision, else the mention as it is."""
    spark = found.sparkSession
    overrides = O.ALIAS_OVERRIDES if overrides is None else overrides
    fixed = F.broadcast(spark.createDataFrame([(k, c, t) for k, (c, t) in overrides.items()], "_key string, _fixed string, _fixed_type string"))
    rows = found.withColumn("_key", F.lower(T.compact_ends(F.col("surface")))).join(fixed, "_key", "left")
    if decisions is None:
        rows = rows.withColumns({"_canonical": F.lit(None).cast("string"), "_type": F.lit(None).cast("string"), "_keep": F.lit(None).cast("boolean")})
    else:
        rows = rows.join(decisions.select("surface", F.col("canonical").alias("_canonical"), F.col("type").alias("_type"), F.col("keep").alias("_keep")), "surface", "left")
    keep = F.when(F.col("_fixed").isNotNull(), True).otherwise(F.coalesce("_keep", F.lit(True)))
    out = rows.withColumns({"canonical": F.coalesce("_fixed", "_canonical", "surface"), "kind": F.coalesce("_fixed_type", "_type", "type")})
    return out.withColumn("keep", keep & ~is_placeholder(F.col("surface")) & ~is_placeholder(F.col("canonical"))).drop("_key", "_fixed", "_fixed_type", "_canonical", "_type", "_keep")


def entities(decided: DataFrame) -> DataFrame:
    """``key, id, canonical_name, type, aliases, mentions, surfaces``: kept mentions by type and name.

    Mentions come in the order of count, then first sight; the first spelling names the
    entity. Two names of one id get a short hash of the name behind it.
    """
    order = F.struct((-F.col("count")).alias("c"), "first")
    name = F.lower(T.compact(F.col("canonical")))
    rows = decided.where("keep").withColumn("key", F.concat("kind", F.lit("::"), name)).withColumn("_order", order)
    found = rows.groupBy("key").agg(
        F.min_by("canonical", "_order").alias("canonical_name"),
        F.first("kind").alias("type"),  # equal in a group, as it is part of the key
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_order", "surface"))), lambda x: x["surface"])).alias("aliases"),
        F.sum("count").alias("mentions"),
    )
    base = T.entity_id(F.col("type"), F.col("canonical_name"))
    shared = found.groupBy(base.alias("_id")).agg(F.count("*").alias("_same"))
    named = found.withColumn("_id", base).join(shared, "_id")
    return named.select("key", F.when(F.col("_same") > 1, F.concat("_id", F.lit("-"), F.substring(F.sha1("key"), 1, 8))).otherwise(F.col("_id")).alias("id"), "canonical_name", "type", "aliases", "mentions")


def merge(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entities merged along ``a, b`` pairs of ids, whole components at once.

    ``pairs`` may have ``canonical``, a chosen name: the member of that name wins and the
    entity takes it. Otherwise the member with most mentions (of equals, the smallest id)
    does; ``merged_ids`` lists all.
    """
    parts = connected_components(pairs)
    chosen = pairs.select("a", (F.col("canonical") if "canonical" in pairs.columns else F.lit(None).cast("string")).alias("chosen")).where("chosen != ''")
    names = chosen.join(parts.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.min("chosen").alias("chosen"))
    rows = found.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("_part", F.coalesce("component", "id")).join(names, "component", "left")
    other = F.coalesce(F.lower(F.trim("canonical_name")) != F.lower(F.trim("chosen")), F.lit(False))
    order = F.struct(other.alias("other"), (-F.col("mentions")).alias("m"), "id")
    return rows.withColumn("_order", order).groupBy("_part").agg(
        F.min_by("id", "_order").alias("id"),
        F.coalesce(F.max("chosen"), F.min_by("canonical_name", "_order")).alias("canonical_name"),
        F.min_by("type", "_order").alias("type"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_order", "aliases"))), lambda x: x["aliases"]))).alias("aliases"),
        F.sum("mentions").alias("mentions"),
        F.array_sort(F.collect_list("id")).alias("merged_ids"),
    ).drop("_part")


def summary(found: DataFrame, most: int = 15, aliases: int = 4) -> DataFrame:
    """``what, key, n, detail``: entities in all, by type, and the most mentioned ones with further names."""
    none = F.lit("").alias("detail")
    total = found.agg(F.count("*").alias("n")).select(F.lit("total").alias("what"), F.lit("entities").alias("key"), "n", none)
    by_type = found.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), "key", "n", none)
    others = F.filter("aliases", lambda x: x != F.col("canonical_name"))
    detail = F.concat(F.array_join(F.slice(others, 1, aliases), ", "), F.when(F.size(others) > aliases, F.lit(" …")).otherwise(F.lit("")))
    label = F.concat(F.lit("["), "type", F.lit("] "), "canonical_name")
    top = found.orderBy(F.desc("mentions"), "id").limit(most).select(F.lit("top").alias("what"), label.alias("key"), F.col("mentions").alias("n"), detail.alias("detail"))
    return total.unionByName(by_type).unionByName(top)


def rewrite(triples: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Triples with entity ids; those with an end that was dropped, or a loop, go.

    ``surfaces`` has ``surface, id, name, type``, a row for each kept surface.
    """
    s, o = (surfaces.toDF(end, f"{end}_id", f"{end}_name", f"{end}_kind") for end in ("subject", "object"))
    rows = triples.join(s, "subject").join(o, "object").where("subject_id != object_id")
    return rows.select("ord", "subject_id", "subject_name", F.col("subject_kind").alias("subject_type"), "relation", "object_id", "object_name", F.col("object_kind").alias("object_type"), "description", "document_id", "chunk_id")
