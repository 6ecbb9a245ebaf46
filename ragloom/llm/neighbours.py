"""Operator 5: near-duplicates of embeddings by a robust-pruned flat graph.

Vectors go to overlapping cluster shards: the nearest centroid's, and those of others
about as near. Each shard builds a graph whose edges are robustly pruned (an edge goes
if a kept neighbour is much nearer to its end); a vector's adjacency lists of all its
shards are united. Every vector then searches its home shard by those lists, greedily
from medoids and itself, and goes on from everything within range. Cosines are verified
in double precision, and recall is audited against brute force; a shortfall widens the
overlap and the search, and is an error after the last widening.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.components import connected_components
from ragloom.llm.shared import checkpoint, hot_left_join, load, small_batches
from ragloom.llm.simhash import forest
from ragloom.llm.topk import usable

log = logging.getLogger(__name__)

#: Cosine from which vectors are linked.
THRESHOLD = 0.95
#: The centroids are fitted to a sample of a sixteenth of the vectors, of ``SAMPLE`` rows at
#: least and ``SAMPLE_NUMBERS`` components at most (64 MB); queries of the audit's first block.
SAMPLE, SAMPLE_NUMBERS, AUDIT = 8192, 1 << 23, 128
#: Queries with links that the audit wants; its blocks grow until they are seen or all vectors
#: were asked.
LINKED = 64
#: Recall that the audit asks for, and how often a shortfall widens the search.
RECALL, WIDEN = 0.95, 3


@dataclass(frozen=True)
class Settings:
    """Vectors of a home cluster and of a block, about; the overlap: further centroids at
    most ``slack`` (and the threshold's chord at least) farther than the nearest, ``cells``
    in all, more where there are more centroids than 2 to that power; edges of a vertex, the
    pruning factor; medoids, beam width and rounds of the search."""

    home: int = 512
    block: int = 2048
    cells: int = 4
    slack: float = 0.3
    degree: int = 20
    alpha: float = 1.2
    medoids: int = 8
    beam: int = 8
    rounds: int = 4

    def wider(self) -> Settings:
        return replace(self, cells=2 * self.cells, slack=2 * self.slack, degree=2 * self.degree, medoids=2 * self.medoids, beam=2 * self.beam, rounds=2 * self.rounds)


def unit(rows: pd.Series) -> np.ndarray:
    """Vectors of one dimension as rows of length one."""
    x = np.stack([np.asarray(r, float) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means; an empty cluster keeps its centre."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(steps):
        own = np.concatenate([(sample[i : i + 1024] @ c.T).argmax(1) for i in range(0, len(sample), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def robust_prune(x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of every vertex, -1 where there are fewer: the nearest candidate is kept, and
    drops those to which it is nearer by ``alpha`` than the vertex; then the next."""
    n = len(x)
    d = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
    left = d.copy()
    np.fill_diagonal(left, np.inf)
    out = np.full((n, degree), -1, np.int64)
    for j in range(min(degree, n - 1)):
        p = left.argmin(1)
        ok = np.isfinite(left[np.arange(n), p])
        if not ok.any():
            break
        out[ok, j] = p[ok]
        left[(alpha * d[p] <= d) & ok[:, None]] = np.inf
        left[np.arange(n), p] = np.inf
    return out


def medoids(x: np.ndarray, n: int) -> np.ndarray:
    """The vertex nearest to the mean, then each time the one farthest from those chosen."""
    chosen = [int((x @ x.mean(0)).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return np.array(chosen)


def range_search(q: np.ndarray, own: np.ndarray, x: np.ndarray, edges: np.ndarray, threshold: float, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vertex) of cosine ``threshold`` or more that the graph leads to.

    All queries move at once. ``own``: the query's vertex or -1. A round expands the
    best of each query's beam; whatever is within range is expanded too, without limit.
    """
    m, n = len(q), len(x)
    cos = np.full((m, n), -2.0)
    opened = np.zeros((m, n), bool)

    def visit(qi: np.ndarray, xi: np.ndarray) -> None:
        key = np.unique(qi * n + xi)
        qi, xi = key // n, key % n
        new = cos[qi, xi] == -2.0
        qi, xi = qi[new], xi[new]
        for i in range(0, len(qi), 32768):
            a, b = qi[i : i + 32768], xi[i : i + 32768]
            cos[a, b] = np.einsum("ij,ij->i", q[a], x[b])

    def expand(qi: np.ndarray, xi: np.ndarray) -> None:
        opened[qi, xi] = True
        for i in range(0, len(qi), 65536):
            ends = edges[xi[i : i + 65536]]
            a = np.repeat(qi[i : i + 65536], ends.shape[1])
            ok = ends.ravel() >= 0
            visit(a[ok], ends.ravel()[ok])

    starts = medoids(x, s.medoids)
    visit(np.repeat(np.arange(m), len(starts)), np.tile(starts, m))
    known = np.flatnonzero(own >= 0)
    visit(known, own[known])
    for _ in range(s.rounds):
        open_cos = np.where(opened, -2.0, cos)
        width = min(s.beam, n)
        top = np.argpartition(-open_cos, width - 1, axis=1)[:, :width]
        qi, xi = np.repeat(np.arange(m), width), top.ravel()
        ok = open_cos[qi, xi] > -2.0
        if not ok.any():
            break
        expand(qi[ok], xi[ok])
    while True:
        qi, xi = np.nonzero((cos >= threshold) & ~opened)
        if not len(qi):
            break
        expand(qi, xi)
    return np.nonzero(cos >= threshold)


class Cells:
    """Centroids for each dimension; a dimension that the sample lacks has one cell."""

    def __init__(self, sample: pd.Series, counts: dict[int, int], s: Settings, threshold: float = THRESHOLD):
        self.settings, self.by_dim, self.first = s, {}, {}
        self.slack = max(s.slack, float(np.sqrt(max(0.0, 2 - 2 * threshold))))
        sizes = sample.map(len)
        for dim in sorted(set(sizes)):
            x = unit(sample[sizes == dim])
            self.by_dim[dim] = centroids(x, max(1, min(len(x) // 4 or 1, -(-counts.get(dim, 1) // s.home))))
            self.first[dim] = sum(len(c) for d, c in self.by_dim.items() if d < dim)

    def assign(self, vectors: list) -> list[list[int]]:
        """Each vector's cells, its home first; all vectors of one length at once."""
        out: list[list[int]] = [[-len(v)] for v in vectors]
        sizes = np.array([len(v) for v in vectors])
        for dim, c in self.by_dim.items():
            own = np.flatnonzero(sizes == dim)
            most = min(len(c), max(self.settings.cells, len(c).bit_length()))
            for at in range(0, len(own), 512):
                part = own[at : at + 512]
                d = np.sqrt(np.maximum(0, 2 - 2 * (unit([vectors[i] for i in part]) @ c.T)))
                near = np.argpartition(d, most - 1, axis=1)[:, :most]
                near = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(d, near, 1)), axis=1), 1)
                d = np.take_along_axis(d, near, 1)
                ok = d <= d[:, :1] + self.slack
                for i, cells, keep in zip(part.tolist(), near + self.first[dim], ok, strict=True):
                    out[i] = cells[keep].tolist()
        return out


def linkable(vector: Column) -> Column:
    """True for vectors that have a direction."""
    return usable(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def place(vector: str, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on the vector alone: the order of samples."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(vector)), 11) / float(1 << 53)


def found_links(classes: DataFrame, threshold: float, s: Settings) -> DataFrame:
    """``a, b, n``: rows with ``n`` above 0 add to the links of ``a``; the others, of ``n`` 0, are links of a spanning forest.

    ``classes`` has ``rep, vector, weight``, all vectors distinct.
    """
    spark = classes.sparkSession
    counts = {r["dim"]: r["n"] for r in classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    rows = min(max(SAMPLE, sum(counts.values()) // 16), max(SAMPLE // 8, SAMPLE_NUMBERS // max(counts, default=1)))
    part = rows / max(1, sum(counts.values()))
    chosen = classes.select("vector", place("vector").alias("place")).where(F.col("place") < part)  # a threshold: nothing is ordered before it is few
    sample = chosen.orderBy("place").limit(rows).select("vector").toPandas()["vector"]
    cells = spark.sparkContext.broadcast(Cells(sample, counts, s, threshold))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.value.assign(batch.column(1).to_pylist()), pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    kind = classes.schema["vector"].dataType.simpleString()
    dealt = checkpoint(classes.select("rep", "vector", "weight").mapInArrow(assign, f"rep long, vector {kind}, weight long, cells array<long>"))
    at_home = F.col("cell") == F.col("cells")[0]
    members = dealt.withColumn("cell", F.explode("cells"))
    # A cell with more members than a block is cut into blocks, and so are its home members, who ask.
    cut = lambda n: F.greatest(F.lit(1), F.ceil(n / s.block)).cast("int")
    blocks = members.groupBy("cell").agg(cut(F.count("*")).alias("blocks"), cut(F.sum(at_home.cast("int"))).alias("q_blocks"))
    blocks = F.broadcast(blocks)  # a row a centroid, and these are fewer than the sample
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    placed = members.join(blocks, "cell").withColumn("own", own)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        reps = rows["rep"].to_numpy(np.int64)
        edges = robust_prune(unit(rows["vector"]), s.degree, s.alpha)
        back = [[] for _ in reps]
        for i, ends in enumerate(edges):
            for j in ends[ends >= 0]:
                back[j].append(i)
        lists = [reps[np.unique(np.r_[e[e >= 0], np.array(b[: s.degree], np.int64)])] for e, b in zip(edges, back, strict=True)]
        return pd.DataFrame({"rep": reps, "ends": lists})

    shards = placed.select("cell", "own", "rep", "vector").groupBy("cell", "own").applyInPandas(build, "rep long, ends array<long>")
    # Bounded lists: two directions of ``degree`` edges for each of at most ``cells`` shards.
    graph = shards.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("ends"))).alias("ends"))
    # The lists come to one row a vector, before it is dealt to its cells again.
    listed = checkpoint(dealt.join(graph, "rep"))
    vertices = listed.withColumn("cell", F.explode("cells")).join(blocks, "cell").withColumn("home", F.col("cells")[0])
    # Few ask: a block of members goes to each block of askers, nearly always one, and these to all blocks.
    none = F.array().cast("array<long>")
    targets = vertices.select("cell", own.alias("c_block"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"), "rep", "vector", "weight", "home", none.alias("cells"), "ends", F.lit(True).alias("is_target"))
    asking = vertices.where(F.col("cell") == F.col("home"))
    askers = asking.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c_block"), F.pmod(F.xxhash64("rep"), "q_blocks").cast("int").alias("q_block"), "rep", "vector", "weight", "home", "cells", none.alias("ends"), F.lit(False).alias("is_target"))

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        targets, queries = rows[rows["is_target"]], rows[~rows["is_target"]]
        if not len(targets) or not len(queries):
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})
        x_reps, q_reps = targets["rep"].to_numpy(np.int64), queries["rep"].to_numpy(np.int64)
        place = {r: i for i, r in enumerate(x_reps.tolist())}
        lists = [[place[e] for e in ends if e in place] for ends in targets["ends"]]
        edges = np.full((len(lists), max(1, max(map(len, lists)))), -1, np.int64)
        for i, ends in enumerate(lists):
            edges[i, : len(ends)] = ends
        own = np.array([place.get(r, -1) for r in q_reps.tolist()])
        x, q = unit(targets["vector"]), unit(queries["vector"])
        x_weight, q_weight = targets["weight"].to_numpy(np.int64), queries["weight"].to_numpy(np.int64)
        widest = max(map(len, queries["cells"]))
        q_cells = np.array([[*c, *[c[0]] * (widest - len(c))] for c in queries["cells"]], np.int64)
        x_home = targets["home"].to_numpy(np.int64)
        a_all, b_all, n_all = [], [], []
        for at in range(0, len(q), 512):
            qi, xi = range_search(q[at : at + 512], own[at : at + 512], x, edges, threshold, s)
            qi = qi + at
            ok = q_reps[qi] != x_reps[xi]
            qi, xi = qi[ok], xi[ok]
            got = np.bincount(qi, x_weight[xi], len(q)).astype(np.int64)
            # The other end counts this link where it looks for it itself; else it is counted here.
            alone = ~(q_cells[qi] == x_home[xi, None]).any(axis=1)
            back = np.bincount(xi[alone], q_weight[qi[alone]], len(x)).astype(np.int64)
            for reps, n in ((q_reps, got), (x_reps, back)):
                a_all.append(reps[n > 0])
                b_all.append(reps[n > 0])
                n_all.append(n[n > 0])
            reps = np.unique(np.r_[q_reps[qi], x_reps[xi]])
            a, b = forest(len(reps), np.searchsorted(reps, q_reps[qi]), np.searchsorted(reps, x_reps[xi]))
            a_all.append(reps[a])
            b_all.append(reps[b])
            n_all.append(np.zeros(len(a), np.int64))
        return pd.DataFrame({"a": np.concatenate(a_all), "b": np.concatenate(b_all), "n": np.concatenate(n_all)})

    return checkpoint(targets.unionByName(askers).groupBy("cell", "c_block", "q_block").applyInPandas(search, "a long, b long, n long"))


def audit(classes: DataFrame, found: DataFrame, threshold: float, first: int = AUDIT, linked: int = LINKED) -> float:
    """The mean, over sampled vectors that have links, of the part that was found of what brute force finds.

    Blocks of vectors in the order of a hash are asked, each four times the last, until
    ``linked`` vectors with links were seen or none is left: rare links cost more, but
    are never taken as found unseen. 1 where no vector has a link.
    """
    spark = classes.sparkSession
    counted = checkpoint(found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n")))
    order, n = place("vector", 1), max(1, classes.count())
    recalls, start, size = [], 0.0, float(first)
    while start < 1.0 and len(recalls) < linked:
        # Of a large table a block is some 8,192 vectors at most; further blocks follow.
        end = min(1.0, start + min(size, 64.0 * AUDIT) / n)
        asked = classes.select("rep", "vector").where((order >= start) & (order < end)).toPandas()
        start, size = end, 4 * size
        if not len(asked):
            continue
        true = true_links(classes, asked, threshold)
        ids = F.broadcast(spark.createDataFrame([(int(r),) for r in true], "rep long")) if true else None
        got = {r["rep"]: r["n"] for r in counted.join(ids, "rep").collect()} if true else {}
        recalls += [min(1.0, got.get(r, 0) / m) for r, m in true.items()]
    return float(np.mean(recalls)) if recalls else 1.0


def true_links(classes: DataFrame, asked: pd.DataFrame, threshold: float) -> dict[int, int]:
    """Links of the asked vectors by brute force; those without any are left out."""
    shared = classes.sparkSession.sparkContext.broadcast(asked)

    def brute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        total = np.zeros(len(own), np.int64)
        own_dims, own_reps = own["vector"].map(len).to_numpy(), own["rep"].to_numpy()
        queries = {dim: (np.flatnonzero(own_dims == dim), unit(own["vector"][own_dims == dim])) for dim in set(own_dims.tolist())}
        for rows in parts:
            dims = rows["vector"].map(len)
            for dim in set(dims):
                x, (q, vectors) = rows[dims == dim], queries.get(dim, ([], None))
                ends = unit(x["vector"]).T if len(q) else None
                for i in range(0, len(q), 512):
                    at = q[i : i + 512]
                    hit = (vectors[i : i + 512] @ ends >= threshold) & (own_reps[at, None] != x["rep"].to_numpy()[None])
                    total[at] += hit @ x["weight"].to_numpy(np.int64)
        yield pd.DataFrame({"rep": own_reps[total > 0], "n": total[total > 0]})

    return {r["rep"]: r["n"] for r in classes.mapInPandas(brute, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).collect()}


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, settings: Settings | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, n_links, component_id, kept``: a row a vector.

    Vectors that are null, zero or hold null or non-finite components link with nothing,
    nor do those of unequal lengths. Equal vectors are searched once and count as often
    as they occur. Rows that share an id are vectors of their own; a null id is kept
    apart: it counts as a link, but never names a component. Components of which no
    vector has an id have a null ``component_id``. An empty table gives no rows; extra
    columns are left out. Raises ``RuntimeError`` where the audited recall stays below
    ``RECALL`` after the last widening; the recall that was found goes to the log.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    s = settings or Settings()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), linkable(F.col(vector_col)).alias("ok"))
    # Equal vectors share 128 bits of hash, by which rows find their class again without their vectors.
    keys = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")]
    usable_ = rows.where("ok").select("id", "vector", *keys)
    classes = usable_.groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("weight"))
    # Numbered where they lie: unique, whatever ids there are, and fixed by the checkpoint.
    classes = checkpoint(classes.withColumn("rep", F.monotonically_increasing_id()))
    recall, found = 0.0, None
    for _ in range(WIDEN):
        found = found_links(classes, threshold, s)
        recall = audit(classes, found, threshold)
        log.info("recall of the links of audited vectors: %.4f", recall)
        if recall >= RECALL:
            break
        s = s.wider()
    else:
        raise RuntimeError(f"recall of {recall:.3f} after the last widening, {RECALL} is asked for")
    n = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("n = 0"))
    slim = classes.select("rep", "k1", "k2", "least", "weight")
    known = slim.join(n, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    joined = hot_left_join(known.select("k1", "k2", "weight", F.col("n").alias("links"), "component"), least.drop("n"), ["component"], least.select("component", "n"))
    label = joined.select("k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = hot_left_join(usable_.select("id", "k1", "k2"), label, ["k1", "k2"], slim.select("k1", "k2", F.col("weight").alias("n")))
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull() & F.col("component_id").isNull()).alias("kept"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all embeddings."""
    return embedding_components(load(spark, sf_dir, "embeddings"))
