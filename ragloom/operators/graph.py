"""The property graph as ``nodes`` and ``edges``: loading, patterns, paths, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.sources.workers import checkpoint

#: Longest path that is looked for.
MAX_HOPS = 6
#: Nodes of a frontier that are broadcast.
FEW = 50_000


def aggregate_edges(triples: DataFrame) -> DataFrame:
    """One edge for each (subject, relation, object) with its provenance and count.

    Values are distinct, in the order in which ``ord`` has them first; empty ones drop
    out. A value's repeats collapse before the shuffle, so that a list holds what the
    edge stores and nothing more.
    """
    keys = ["subject_id", "relation", "object_id"]
    kinds = {"chunk_ids": "chunk_id", "episodes": "document_id", "descriptions": "description"}
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()]))
    # The count of an edge's rows is that of one of the kinds, empty values included.
    each = triples.select(*keys, "ord", values.alias("x")).groupBy(*keys, "x.kind", "x.value").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == k) & (F.col("value") != ""), F.struct("ord", "value")))), lambda x: x["value"]).alias(k)
    return each.groupBy(*keys).agg(*[listed(k) for k in kinds], F.sum(F.when(F.col("kind") == "chunk_ids", F.col("n")).otherwise(0)).alias("count"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without a new one, and the new ones, which replace all properties."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def loadable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.toDF("subject_id"), "subject_id", "left_semi").join(ids.toDF("object_id"), "object_id", "left_semi")


def named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``a`` and ``b``, the names of their ends."""
    s = nodes.select(F.col("id").alias("subject_id"), F.col("name").alias("a"), F.col("type").alias("a_type"))
    o = nodes.select(F.col("id").alias("object_id"), F.col("name").alias("b"), F.col("type").alias("b_type"))
    return edges.join(s, "subject_id").join(o, "object_id")


def hop(edges: DataFrame, *relations: str) -> DataFrame:
    """Directed edges of any of the relations; of all without one."""
    return edges.where(F.col("relation").isin(*relations)) if relations else edges


def undirected(edges: DataFrame) -> DataFrame:
    """Edges in both directions; a loop stays one row."""
    swapped = edges.where("subject_id != object_id").withColumns({"subject_id": F.col("object_id"), "object_id": F.col("subject_id")})
    return edges.unionByName(swapped)


def two_hop_cycles(edges: DataFrame, relation: str) -> DataFrame:
    """``a, b`` with the relation in both directions, once for each direction.

    A match never uses one relationship twice, so a loop alone is no cycle.
    """
    own = hop(edges, relation).where("subject_id != object_id").select("subject_id", "object_id")
    back = own.toDF("object_id", "subject_id")
    return own.join(back, ["subject_id", "object_id"]).select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("subject_id = object_id")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    ends = edges.select(F.col("subject_id").alias("id")).union(edges.select("object_id"))
    return nodes.join(ends, "id", "left_anti")


def chain(edges: DataFrame, relations: list[str]) -> DataFrame:
    """``n0, n1, ...``: paths that follow the relations; ``<R`` goes against R's direction."""
    out = None
    for i, r in enumerate(relations):
        ends = ("object_id", "subject_id") if r.startswith("<") else ("subject_id", "object_id")
        step = hop(edges, r.lstrip("<")).select(*[F.col(c) for c in ends]).toDF(f"n{i}", f"n{i + 1}")
        out = step if out is None else out.join(step, f"n{i}")
    return out.select(*[f"n{i}" for i in range(len(relations) + 1)])


def chain_counts(edges: DataFrame, relations: list[str]) -> DataFrame:
    """``n0, end, paths``: how many paths of ``chain`` lead from where to where.

    Paths are counted after every hop, so a step joins one row for each start and node
    reached instead of one for each path, however many paths meet in a node.
    """
    now = None
    for r in relations:
        ends = ("object_id", "subject_id") if r.startswith("<") else ("subject_id", "object_id")
        step = hop(edges, r.lstrip("<")).select(F.col(ends[0]).alias("at"), F.col(ends[1]).alias("end"))
        rows = step.select(F.col("at").alias("n0"), "end", F.lit(1).cast("long").alias("paths")) if now is None else now.withColumnRenamed("end", "at").join(step, "at")
        now = rows.groupBy("n0", "end").agg(F.sum("paths").alias("paths"))
    return now


def same_pair(edges: DataFrame, one: str, two: str) -> DataFrame:
    """Ordered pairs that have both relations."""
    keys = ["subject_id", "object_id"]
    return hop(edges, one).select(*keys).distinct().join(hop(edges, two).select(*keys).distinct(), keys)


def top_n(rows: DataFrame, by: str, value: str, n: int, tie: list[str]) -> DataFrame:
    """The n rows of highest ``value`` for each ``by``, with their ``rank``."""
    w = Window.partitionBy(by).orderBy(F.desc(value), *tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def subgraph(edges: DataFrame, seeds: DataFrame, limit: int = 80) -> DataFrame:
    """The first ``limit`` distinct edges, by id, with an end among the seeds (``id``)."""
    ids = seeds.select("id").distinct()
    out = edges.join(ids.toDF("subject_id"), "subject_id", "left_semi").unionByName(edges.join(ids.toDF("object_id"), "object_id", "left_semi"))
    keys = ["subject_id", "relation", "object_id"]
    return out.select(*keys).distinct().orderBy(*keys).limit(limit)


def subgraph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("subject_id").alias("id")).union(edges.select("object_id")).distinct()
    return nodes.join(ends, "id", "left_semi")


def first_evidence(rows: DataFrame, order: list[str]) -> DataFrame:
    """``chunk_id, episode, description`` of rows with the three lists, in the order given.

    A chunk takes the episode and the description at its place, else the first; of rows
    with the same chunk the first counts.
    """
    each = rows.select(*order, "episodes", "descriptions", F.posexplode("chunk_ids").alias("pos", "chunk_id")).where(F.coalesce("chunk_id", F.lit("")) != "")
    at = lambda c: F.coalesce(F.get(c, F.col("pos")), F.get(c, F.lit(0)), F.lit(""))
    held = F.struct(at("episodes").alias("episode"), at("descriptions").alias("description"))
    first = each.groupBy("chunk_id").agg(F.min_by(held, F.struct(*order, "pos")).alias("held"))
    return first.select("chunk_id", "held.episode", "held.description")


def evidence(edges: DataFrame) -> DataFrame:
    """``first_evidence`` of edges, in the order of their ends and relations."""
    return first_evidence(edges, ["subject_id", "relation", "object_id"])


def hop_distances(edges: DataFrame, start: str, hops: int = MAX_HOPS) -> DataFrame:
    """``node, hops, parent`` of all nodes within ``hops``, ignoring directions.

    Breadth first: a frontier joins the edges as they come, first those that leave it, then
    those that reach it, the smallest parent wins, nodes seen before drop out. The edges are
    neither copied nor sorted out, so give each with few columns; repeats and loops change
    nothing. Ids may be of any type that compares. Every level is checkpointed, what it
    shuffled is deleted at once, and none reaches the driver. A frontier of at most ``FEW``
    nodes is broadcast, a larger one is hashed in parts, so that the edges aren't sorted.
    """
    spark = edges.sparkSession
    own = edges.select("subject_id", "object_id").where("subject_id != object_id")
    kind = edges.schema["subject_id"].dataType.simpleString()
    frontier = spark.createDataFrame([(start, 0, None)], f"node {kind}, hops int, parent {kind}")
    seen, n = frontier, 1
    for level in range(1, hops + 1):
        sides = []
        for near, far in (("subject_id", "object_id"), ("object_id", "subject_id")):
            at = frontier.select(F.col("node").alias(near))
            met = own.join(at.hint("broadcast" if n <= FEW else "shuffle_hash"), near).groupBy(F.col(far).alias("node")).agg(F.min(near).alias("parent"))
            sides.append(checkpoint(met.join(seen.select("node").hint("shuffle_hash"), "node", "left_anti"), clear=True))
        step = sides[0].unionByName(sides[1]).groupBy("node").agg(F.min("parent").alias("parent"))
        frontier = checkpoint(step.select("node", F.lit(level).alias("hops"), "parent"), clear=True)
        n = frontier.count()
        if not n:
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, hops: int = MAX_HOPS) -> DataFrame:
    """``step, node`` along one shortest path, the smallest parent at each step; no row without a path."""
    found = checkpoint(hop_distances(edges, start, hops))
    path, at = [], end
    for _ in range(hops + 1):  # a step a hop, from the end
        row = found.where(F.col("node") == at).first()
        if row is None:
            return found.sparkSession.createDataFrame([], "step int, node string")
        path.append((row["hops"], at))
        if row["parent"] is None:
            break
        at = row["parent"]
    return found.sparkSession.createDataFrame(path[::-1], "step int, node string")


def path_rows(nodes: DataFrame, edges: DataFrame, start: str | None, end: str | None, hops: int = MAX_HOPS) -> DataFrame:
    """``nodes, edges``: the shortest path as one row of lists; no row without one, or where the ends are equal.

    Of several edges between two steps the first by key counts.
    """
    spark = nodes.sparkSession
    steps = [r["node"] for r in shortest_path(edges, start, end, hops).orderBy("step").collect()] if start and end and start != end else []  # a step a hop
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(steps, steps[1:], strict=False))], "step int, a string, b string")
    ends = (F.col("subject_id") == F.col("a")) & (F.col("object_id") == F.col("b")) | (F.col("subject_id") == F.col("b")) & (F.col("object_id") == F.col("a"))
    own = edges.where(F.col("subject_id").isin(steps) & F.col("object_id").isin(steps)) if steps else edges.limit(0)
    taken = own.join(F.broadcast(pairs), ends).groupBy("step").agg(F.min_by(F.struct(*own.columns), F.struct("subject_id", "relation", "object_id")).alias("e"))
    places = spark.createDataFrame(list(enumerate(steps)), "step int, id string")
    named_ = nodes.join(F.broadcast(places), "id").select("step", F.struct(*nodes.columns).alias("n"))
    in_order = lambda rows, c, name: rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("step", c))), lambda x: x[c]).alias(name))
    both = in_order(named_, "n", "nodes").crossJoin(in_order(taken, "e", "edges"))  # a row each
    return both.where(F.size("edges") > 0)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, key, n``: totals, nodes by type, edges by relation."""
    total = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), F.lit("all").alias("key"), "n").unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.lit("all").alias("key"), "n"))
    by_type = nodes.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), "key", "n")
    by_relation = edges.groupBy(F.col("relation").alias("key")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("what"), "key", "n")
    return total.unionByName(by_type).unionByName(by_relation)


def names_within_names(nodes: DataFrame, kind: str, most: int = 20) -> DataFrame:
    """The first ``most`` pairs ``a, b`` of nodes of a type where a's name holds b's, a's id the smaller.

    Names meet by a shared token instead of all with all: what holds a name holds its
    longest inner run of letters and digits, of which the first and the last may be cut
    within a word and so are looked for in every part of a token.
    """
    types = nodes.where(F.col("type") == kind).select("id", "name", F.lower("name").alias("low"))
    tokens = F.regexp_extract_all("low", F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    # Any token of b lies within a token of a; a's tokens are listed with all their parts of b's length.
    longest = F.reverse(F.array_sort(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))))
    b = types.select(F.col("id").alias("b_id"), F.col("name").alias("b"), F.col("low").alias("b_low"), F.coalesce(F.get(longest, F.lit(0))["t"], F.lit("")).alias("part"))
    parts = F.flatten(F.transform(tokens, lambda t: F.flatten(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.transform(F.sequence(i, F.length(t)), lambda j: F.substring(t, i, j - i + 1))))))
    a = types.select(F.col("id").alias("a_id"), F.col("name").alias("a"), F.col("low").alias("a_low"), F.explode(F.array_distinct(F.concat(parts, F.array(F.lit(""))))).alias("part"))
    known = b.select("part").distinct()
    found = a.join(known, "part", "left_semi").join(b, "part").where((F.col("a_id") < F.col("b_id")) & F.contains("a_low", "b_low"))
    return found.select("a", "b").orderBy("a", "b").limit(most)


def inspect(nodes: DataFrame, edges: DataFrame, ontology, kind: str | None = None) -> dict[str, DataFrame]:
    """Quality probes of a graph, by name; doubtful names are looked for in one type, the ontology's first."""
    allowed = F.broadcast(ontology.allowed(nodes.sparkSession).toDF("relation", "a_type", "b_type"))
    return {
        "top_per_type": top_n(nodes, "type", "mentions", 12, ["id"]),
        "self_loops": self_loops(edges),
        "violations": named(edges, nodes).join(allowed, ["relation", "a_type", "b_type"], "left_anti"),
        "isolated": isolated(nodes, edges),
        "names_within_names": names_within_names(nodes, kind or ontology.node_types[0]),
        "samples": top_n(named(edges, nodes), "relation", "count", 4, ["subject_id", "object_id"]),
    }
