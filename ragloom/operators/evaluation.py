"""Rubric scores: validation, totals, winners and the scoreboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rubric's dimensions, each 0 to 2, and the systems in their order.
DIMENSIONS = ("relevance", "constraint_handling", "evidence_grounding", "reasoning_transparency", "hallucination_resistance")
SYSTEMS = ("Vector", "Graph", "Hybrid")
MAX_TOTAL = 2 * len(DIMENSIONS)
#: The systems' names in evaluation tables, and such a table's columns.
TABLE_NAMES = {"Vector": "vector_rag", "Graph": "graph_rag", "Hybrid": "hybrid_rag"}
COLUMNS = (
    *("index", "id", "category", "question", "vector_answer", "graph_answer", "hybrid_answer"),
    *(f"{name}_total" for name in TABLE_NAMES.values()),
    *(f"{name}_{d}" for name in TABLE_NAMES.values() for d in DIMENSIONS),
    *("verdict", "error"),
)


def validated(scores: DataFrame) -> DataFrame:
    """Scores; a value outside 0..2 is an error."""
    bad = F.lit(False)
    for d in DIMENSIONS:
        bad = bad | F.coalesce(~F.col(d).isin(0, 1, 2), F.lit(True))
    first = DIMENSIONS[0]
    return scores.withColumn(first, F.when(bad, F.raise_error(F.lit("a rubric score is not 0, 1 or 2")).cast("int")).otherwise(F.col(first)))


def with_total(scores: DataFrame) -> DataFrame:
    """Adds ``total_score``, the sum of the dimensions."""
    return scores.withColumn("total_score", sum((F.col(d) for d in DIMENSIONS), F.lit(0)))


def winner(totals: dict[str, Column]) -> Column:
    """The system of the highest total; several as ``tie (A/B)`` in the systems' order."""
    best = F.greatest(*totals.values())
    top = F.filter(F.array(*[F.when(v == best, F.lit(k)) for k, v in totals.items()]), lambda x: x.isNotNull())
    return F.when(F.size(top) == 1, F.get(top, F.lit(0))).otherwise(F.concat(F.lit("tie ("), F.array_join(top, "/"), F.lit(")")))


def wins(evaluations: DataFrame, key: str) -> DataFrame:
    """``key, winner`` of rows ``key, system, total_score``."""
    wide = evaluations.groupBy(key).pivot("system", list(SYSTEMS)).agg(F.first("total_score"))
    return wide.select(key, winner({s: F.col(s) for s in SYSTEMS}).alias("winner"))


def scoreboard(evaluations: DataFrame, failed: str = "error") -> DataFrame:
    """Questions, sum and mean of the totals of each system, failed rows left out."""
    kept = evaluations.where(F.col(failed).isNull()) if failed in evaluations.columns else evaluations
    return kept.groupBy("system").agg(F.count("*").alias("questions"), F.sum("total_score").alias("total"), F.avg("total_score").alias("mean"))


def checked_scores(scores: dict | None) -> dict[str, int]:
    """A judge's scores of one system; a missing one, or one that isn't 0, 1 or 2, is an error."""
    out = {}
    for d in DIMENSIONS:
        value = (scores or {}).get(d)
        if isinstance(value, bool) or value not in (0, 1, 2):
            raise ValueError(f"{d} is scored {value!r}, not 0, 1 or 2")
        out[d] = int(value)
    return out


def table(rows: DataFrame) -> DataFrame:
    """The evaluation table: a row a question, with ``COLUMNS``.

    ``rows`` has ``index, id, category, question, system, answer``, the dimensions,
    ``verdict`` and ``error``. Totals and scores are null where a question failed.
    """
    own = with_total(rows)
    of = lambda system, c: F.max(F.when(F.col("system") == system, F.col(c)))
    cells = [of(system, "answer").alias(f"{system.lower()}_answer") for system in SYSTEMS]
    cells += [of(system, "total_score").alias(f"{name}_total") for system, name in TABLE_NAMES.items()]
    cells += [of(system, d).alias(f"{name}_{d}") for system, name in TABLE_NAMES.items() for d in DIMENSIONS]
    wide = own.groupBy("index", "id", "category", "question").agg(*cells, F.max("verdict").alias("verdict"), F.max("error").alias("error"))
    return wide.select(*COLUMNS)


def table_scores(rows: DataFrame, key: str = "index") -> DataFrame:
    """``key, system, total_score, error`` of an evaluation table, for ``scoreboard`` and ``wins``."""
    each = F.explode(F.array(*[F.struct(F.lit(system).alias("system"), F.col(f"{name}_total").alias("total_score")) for system, name in TABLE_NAMES.items()]))
    return rows.select(key, "error", each.alias("x")).select(key, "x.*", "error")


def category(asked: DataFrame, questions: DataFrame) -> DataFrame:
    """``asked`` with the ``category`` of the first gold question (by id) of the same text; empty without one."""
    gold = questions.groupBy("question").agg(F.min_by("category", "id").alias("category"))
    return asked.join(gold, "question", "left").withColumn("category", F.coalesce("category", F.lit("")))


def shown_to_judge(method: str, answer: str, rows: list[str], evidence: list[dict], query: str = "") -> dict:
    """What a judge sees of an answer: its text and the evidence that is displayed, nothing else."""
    pick = lambda names: [{k: e.get(k) for k in names} for e in evidence if set(names) <= set(e)]
    passages, facts = pick(("document_id", "chunk_id", "snippet")), pick(("episode", "chunk_id", "description"))
    if method == "vector":
        return {"answer": answer, "evidence": passages}
    if method == "graph":
        return {"answer": answer, "cypher": query, "graph_rows": rows, "evidence": facts}
    return {"answer": answer, "graph_evidence": facts, "text_evidence": passages}
