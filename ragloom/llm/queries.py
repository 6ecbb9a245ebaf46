"""Queries of this subpackage for the entry module, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm.bpe import op2_bpe
from ragloom.llm.chat import op7_chat
from ragloom.llm.neighbours import op5_neighbours
from ragloom.llm.packing import op3_packing
from ragloom.llm.quality import op9_quality
from ragloom.llm.simhash import op6_simhash
from ragloom.llm.token_counts import op4_token_counts
from ragloom.llm.topk import op8_topk
from ragloom.llm.toxicity import op1_toxicity
from ragloom.llm.urls import op10_urls
from ragloom.llm.urls import oracle_sql as urls_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_bpe, op3_packing, op4_token_counts, op5_neighbours, op6_simhash, op7_chat, op8_topk, op9_quality, op10_urls)
}

#: Exact inner products and the template tree are SQL. The others are tested against brute
#: force, round trips or held-out accuracy: merges by rank, trie scores, packing, graph
#: search, SimHash components and trained models aren't SQL.
ORACLE_SQL: dict[str, str] = {
    "op10_urls": urls_sql(),
    "op8_topk": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
}
