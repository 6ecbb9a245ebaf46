"""Connected components of links, as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.sources.workers import checkpoint

#: Rounds after which something must be wrong: each round halves the distances at least.
MAX_ROUNDS = 60
#: A node with this many links is a hub, and one with a thousandth of all links or more.
HUB = 10_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b", hub: int = HUB) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node that has a link.

    Alternates large-star and small-star steps (Kiveris et al., "Connected components
    in MapReduce and beyond"): each step points a node's neighbours at the smallest
    one it knows. A node's neighbours are never gathered into a list, and the links of
    a hub don't meet under its key: see ``_with_least``. Null ends drop out; loops are
    no links; an empty table gives no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = checkpoint(edges, clear=True)
    before, n = None, edges.count()
    for _ in range(MAX_ROUNDS):
        most = max(hub, n // 1000)
        edges = checkpoint(_small_star(_large_star(edges, most), most), clear=True)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _with_least(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``u, v``) with ``m``, the least ``v`` of each ``u``, and the table of these.

    The least is a partial aggregate. Hubs' leasts, at most two thousand rows as a hub has a
    thousandth of all links, are broadcast; only the rows of other nodes are shuffled.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") >= most).select("u", F.col("m").alias("of_hub")))
    marked = rows.join(hubs, "u", "left")
    own = marked.where("of_hub is null").drop("of_hub").join(least.where(F.col("n") < most).select("u", "m"), "u")
    return marked.where("of_hub is not null").select("u", "v", F.col("of_hub").alias("m")).unionByName(own), least


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Every neighbour larger than the node goes to the node's smallest neighbour or itself."""
    both = edges.select("u", "v").union(edges.select("v", "u").toDF("u", "v"))
    rows, _ = _with_least(both, most)
    return rows.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """The node and its smaller neighbours go to the smallest of them."""
    rows, least = _with_least(edges, most)
    moved = rows.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
