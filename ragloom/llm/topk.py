"""Operator 8: exact top-k by inner product over norm-sorted vectors.

Candidates are dealt to buckets by descending length, queries to blocks by the length
that a candidate must have to be among their best. A candidate goes only to the blocks
for which it is long enough, so before anything is shuffled most pairs of a bucket and
a block drop out. A task meets one bucket with one block and goes down the lengths: where ``|q| * |x|`` is below the query's
k-th best score nothing further can enter; before that, a partial sum over the leading
dimensions of an SVD rotation plus the Cauchy-Schwarz bound of the rest decides which
candidates get their exact integer score.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.shared import checkpoint, first_by_hash, load, small_batches

log = logging.getLogger(__name__)

#: Results of each query.
K = 10
#: Candidates in a bucket and queries in a block, about, and the least that a bucket has where
#: more tasks would do; candidates in a step.
BUCKET, BLOCK, LEAST, STEP = 32768, 8192, 2048, 1024
#: Longest vectors that set each query's first bound, and rows to which the rotation is fitted.
SEEDS, SAMPLE = 1024, 4096
#: Leading dimensions of the partial sums.
LEAD = 16
#: Sums beyond this aren't exact as doubles.
EXACT = 2**52


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components; an empty one has none."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def stack(rows: pd.Series, dim: int) -> np.ndarray:
    """Integer vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; beyond 64 bits they stay at the largest value."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1] < EXACT:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    exact = q.astype(object) @ x.astype(object).T
    return np.vectorize(lambda v: min(max(v, low), high), otypes=[np.int64])(exact)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search(q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, x_ids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """``(query, id, score)`` of each query's k best among ``x``, if these can be among all its best.

    ``bound``: a score that k candidates of the query are known to reach; ``turn``: the
    rotation. Rounding of the rotated floats is allowed for.
    """
    length = np.sqrt((x.astype(float) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    x_ids, x, length = x_ids[order], x[order], length[order]
    q_length = np.sqrt((q.astype(float) ** 2).sum(1))
    q_turned, x_turned = q @ turn, x @ turn
    lead = min(LEAD, q.shape[1])
    rest_q, rest_x = (np.sqrt((v[:, lead:] ** 2).sum(1)) for v in (q_turned, x_turned))
    slack = 1e-9 * (1 + q_length * (length[0] if len(length) else 0))
    reach = bound.astype(float).copy()
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    for at in range(0, len(x), STEP):
        own = slice(at, at + STEP)
        live = np.flatnonzero(q_length * length[at] + slack >= reach)  # Cauchy-Schwarz on whole vectors
        if not len(live):
            break
        part = q_turned[live, :lead] @ x_turned[own, :lead].T + np.outer(rest_q[live], rest_x[own]) + slack[live, None]
        may = part >= reach[live, None]
        rows = np.flatnonzero(may.any(1))
        if not len(rows):
            continue
        columns = np.flatnonzero(may.any(0))
        exact = products(q[live[rows]], x[own][columns])
        for r, scores in zip(live[rows], exact, strict=True):
            ok = (scores >= reach[r]) & (x_ids[own][columns] != q_ids[r])
            if ok.any():
                ids, s = (np.concatenate(p) for p in zip(found[r], (x_ids[own][columns][ok], scores[ok]), strict=True))
                top = best(ids, s, k)
                found[r] = ids[top], s[top]
                if len(top) == k:
                    reach[r] = max(reach[r], float(s[top[-1]]))
    return [(int(q_ids[i]), int(v), int(s)) for i, (ids, scores) in enumerate(found) for v, s in zip(ids, scores, strict=True)]


def needed(q: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The length below which no vector's product with the query reaches its bound; no need is negative."""
    length = np.sqrt((q.astype(float) ** 2).sum(1))
    return np.where(bound <= 0, 0.0, bound / np.maximum(length, 1e-300) * (1 - 1e-9))


def lead_buckets(cands: DataFrame, rows: int) -> list[int]:
    """The first buckets, which have the longest candidates: as many as hold ``rows`` of them."""
    out, seen = [], 0
    for r in cands.groupBy("bucket").agg(F.count("*").alias("n")).orderBy("bucket").collect():  # a row a bucket
        out.append(r["bucket"])
        seen += r["n"]
        if seen >= rows:
            break
    return out


def top_inner_products(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products.

    Components become ``floor(factor * x)``, held within 64 bits. Vectors that are null
    or hold null or non-finite components take no part, nor do rows with a null id. Of
    unequal lengths the shorter vector counts as filled with zeros. Rows that share an
    id are candidates each; as a query their least vector counts, and none of them is a
    candidate of its own id. Fewer candidates than k are all returned; ties go to
    smaller ids. An empty table gives no rows; extra columns are left out.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    whole = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    ints = whole.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * factor)).alias("x"))
    ints = ints.withColumn("length", F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    n, dim = ints.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    dim = max(dim, 1)
    queries = ints.where(is_query(F.col("id"))).groupBy("id").agg(F.min("x").alias("x"))
    n_queries = queries.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, blocks = max(1, -(-n // BUCKET), min(tasks, -(-n // LEAST))), max(1, -(-n_queries // BLOCK))
    # The id is part of the order, so a vector that fills a third of the table is dealt to many buckets.
    sorted_ = ints.repartitionByRange(buckets, F.desc("length"), "id") if buckets > 1 else ints.coalesce(1)
    cands = checkpoint(sorted_.withColumn("bucket", F.spark_partition_id()))
    longest_of = sorted(((r["top"], r["bucket"]) for r in cands.groupBy("bucket").agg(F.max("length").alias("top")).collect()), reverse=True)  # a row a bucket

    # Both samples are bounded by a parameter; the results are exact for any rotation and any seeds.
    sample = first_by_hash(cands.groupBy("id").agg(F.max("x").alias("x")), "id", SAMPLE).toPandas()
    longest = cands.where(F.col("bucket").isin(lead_buckets(cands, SEEDS))).orderBy(F.desc("length"), "id").limit(SEEDS).toPandas()
    turn = spark.sparkContext.broadcast(np.linalg.svd(stack(sample["x"], dim).astype(float).T @ stack(sample["x"], dim).astype(float))[0])
    seeds = spark.sparkContext.broadcast((longest["id"].to_numpy(np.int64), stack(longest["x"], dim)))

    def first_bounds(parts):
        ids, x = seeds.value
        for rows in parts:
            own = stack(rows["x"], dim)
            out = []
            for q, s in zip(rows["id"], products(own, x), strict=True):
                s = s[ids != q]
                out.append(int(np.partition(s, -k)[-k]) if len(s) >= k else -(2**63))
            yield rows.assign(bound=np.array(out, np.int64), need=needed(own, np.array(out, float)))

    bounded = checkpoint(queries.mapInPandas(first_bounds, "id long, x array<long>, bound long, need double"))
    dealt = bounded.repartitionByRange(blocks, "need", "id") if blocks > 1 else bounded.coalesce(1)
    asked = checkpoint(dealt.withColumn("block", F.spark_partition_id()))
    # The least need of each block, ascending, and of each need the buckets that hold candidates as long.
    needs = sorted((r["need"], r["block"]) for r in asked.groupBy("block").agg(F.min("need").alias("need")).collect())  # a row a block
    met_by = spark.sparkContext.broadcast((np.array([x for x, _ in needs]), np.array([b for _, b in needs], np.int64)))
    # Buckets lie in the order of their lengths, so a block meets those up to a last one.
    reach = [(b, max((own for top, own in longest_of if top**0.5 * (1 + 1e-9) >= need), default=-1)) for need, b in needs]
    log.info("%d of %d pairs of a block and a bucket meet", sum(last + 1 for _, last in reach), len(needs) * len(longest_of))
    last = F.broadcast(spark.createDataFrame(reach, "block int, last int"))  # a row a block
    asked = asked.join(last, "block").where("last >= 0").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")

    @F.pandas_udf("array<int>")
    def blocks_of(length: pd.Series) -> pd.Series:
        least, own = met_by.value
        ends = np.searchsorted(least, np.sqrt(length.to_numpy()) * (1 + 1e-9), "right")
        return pd.Series([own[:end].tolist() for end in ends])

    met = cands.withColumn("block", F.explode(blocks_of("length")))

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="int64")})
        rows = search(q["id"].to_numpy(np.int64), stack(q["x"], dim), q["bound"].to_numpy(np.int64), x["id"].to_numpy(np.int64), stack(x["x"], dim), turn.value, k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    near = asked.groupBy("bucket", "block").cogroup(met.groupBy("bucket", "block")).applyInPandas(meet, "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest scores of every hundredth vector."""
    return top_inner_products(load(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
