"""Sinks: JSON lines, vector stores, graph tables, CSV for spreadsheets, event streams."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.sources.workers import exists, replace


def json_lines(rows: DataFrame, path: str, order: str | None = None) -> None:
    """One object a line; with ``order`` the files and lines are sorted by it."""
    (rows.orderBy(order).drop(order) if order else rows).write.mode("overwrite").json(path)


def vector_store(rows: DataFrame, path: str, model: str, dim: int) -> None:
    """Chunks with their vectors, model and dimension as columns."""
    rows.withColumns({"embedding": F.col("embedding").cast("array<float>"), "embedding_model": F.lit(model), "dim": F.lit(dim)}).write.mode("overwrite").parquet(path)


def entities(rows: DataFrame, path: str) -> None:
    """``{"count": n, "entities": [...]}``, the most mentioned first, written row by row on the driver."""
    columns = ("id", "canonical_name", "type", "aliases", "mentions")
    ordered = rows.select(*columns).orderBy(F.desc("mentions"), "id")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{"count": {rows.count()}, "entities": [')
        for i, row in enumerate(ordered.toLocalIterator()):
            f.write(("," if i else "") + "\n" + json.dumps(row.asDict(), ensure_ascii=False))
        f.write("\n]}\n")


def graph(nodes: DataFrame, edges: DataFrame, path: str, reset: bool = True) -> None:
    """Nodes by type and edges by relation. Without ``reset`` new rows replace old ones of their key.

    Both tables are written whole beside the old ones, which are then set aside, and
    deleted once the new ones have taken their places; a failure before leaves them as they were.
    """
    from ragloom.operators.graph import loadable, upsert

    spark = nodes.sparkSession
    parts = (("nodes", nodes, ["id"], "type"), ("edges", loadable(edges, nodes if reset else with_old(nodes, f"{path}/nodes")), ["subject_id", "relation", "object_id"], "relation"))
    for name, rows, keys, by in parts:
        twice = rows.groupBy(*keys).count().where("count > 1").limit(1).count()
        if twice:
            raise ValueError(f"{name} have a key twice")
        if not reset and exists(spark, f"{path}/{name}"):
            rows = upsert(spark.read.parquet(f"{path}/{name}"), rows, keys)
        rows.write.mode("overwrite").partitionBy(by).parquet(f"{path}/{name}_new")
    for name, *_ in parts:
        replace(spark, f"{path}/{name}_new", f"{path}/{name}")


def with_old(nodes: DataFrame, path: str) -> DataFrame:
    """Ids of the nodes and of those that a table has already."""
    new = nodes.select("id")
    return new.union(nodes.sparkSession.read.parquet(path).select("id")) if exists(nodes.sparkSession, path) else new


def spreadsheet_of(rows: DataFrame, path: str) -> None:
    """An evaluation table as a spreadsheet, in the order of its index."""
    spreadsheet(rows.orderBy("index"), path)


def csv_lines(rows: DataFrame) -> DataFrame:
    """``value``: each row as a line of RFC 4180, white space collapsed."""
    return rows.select(F.concat_ws(",", *[F.coalesce(T.csv_cell(F.col(f"`{c}`")), F.lit("")) for c in rows.columns]).alias("value"))


def csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header and CRLF, white space in cells collapsed."""
    flat = rows.select(*[T.compact(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def spreadsheet(rows: DataFrame, path: str) -> None:
    """One small CSV file with a byte-order mark, written row by row on the driver (reports only)."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write(",".join(rows.columns) + "\r\n")
        for row in csv_lines(rows).toLocalIterator():
            f.write(row["value"] + "\r\n")


def events(parts: Iterable[tuple[str, object]]) -> Iterator[str]:
    """Newline-delimited JSON of (kind, payload) events; an exception becomes the last one."""
    try:
        for kind, payload in parts:
            yield json.dumps({"type": kind, "payload": payload}, ensure_ascii=False) + "\n"
    except Exception as e:
        yield json.dumps({"type": "error", "payload": str(e)}, ensure_ascii=False) + "\n"
