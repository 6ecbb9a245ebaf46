"""Segmentation of a text into documents, and of documents into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.sources.workers import ship_code

#: Fixed value: the line that opens a document.
MARKER = r"(?i)^S\s*(\d+)\s*,\s*Ep\s*(\d+)\b"


def segments(rows: DataFrame, marker, order: list, partition: list | None = None) -> DataFrame:
    """Adds ``segment``: how many markers there have been up to the row (0: before the first)."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(F.when(marker, 1).otherwise(0)).over(w))


def split_documents(lines: DataFrame) -> DataFrame:
    """``document_id, title, body`` from ``source, line_no, line``.

    A marker line opens a document, its first non-blank line is the title, the rest the
    body; lines before the first marker of a source drop out. A file is one ordered
    sequence, so a window for each source is the unit of work.
    """
    trimmed = T.compact_ends(F.col("line"))
    numbered = segments(lines.withColumn("line", F.regexp_replace("line", "\r$", "")).withColumn("marked", trimmed.rlike(MARKER)), F.col("marked"), ["line_no"], ["source"]).where("segment > 0")
    blank = T.compact_ends(F.col("line")) == ""
    title_at = F.min(F.when(~F.col("marked") & ~blank, F.col("line_no")))
    keys = ["source", "segment"]
    heads = numbered.groupBy(*keys).agg(F.min_by(F.when(F.col("marked"), T.compact_ends(F.col("line"))), "line_no").alias("head"), title_at.alias("title_at"))
    rows = numbered.join(heads, keys)
    own = rows.groupBy(*keys, "head").agg(
        F.max(F.when(F.col("line_no") == F.col("title_at"), T.compact_ends(F.col("line")))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("marked") & (F.col("line_no") > F.col("title_at")), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    name = T.document_id(F.regexp_extract("head", MARKER, 1), F.regexp_extract("head", MARKER, 2))
    return own.select("source", "segment", name.alias("document_id"), F.coalesce("title", F.upper(name)).alias("title"), T.compact_ends(F.col("body")).alias("body"))


def slices_of(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of sentences: as many as fit in ``size``, then back until ``overlap`` is shared."""
    ends = np.r_[0, np.cumsum(np.asarray(lengths, np.int64) + 1)]
    n, at, out = len(lengths), 0, []
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + size + 1, "right")) - 1)
        out.append((at, end))
        if end >= n:
            break
        back = int(np.searchsorted(ends, ends[end] - overlap, "right")) - 1
        at = back if at < back < end else end
    return out


def chunk_texts(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 150) -> DataFrame:
    """``document_id, chunk_no, chunk_id, text``: sentence-aligned chunks that overlap.

    Sentences are cut in the JVM; only their lengths go to Python, where the fold over
    them runs. A sentence longer than ``size`` is a chunk; blank texts give none.
    """
    ship_code(docs.sparkSession)

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def slices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lengths in batches:
            yield lengths.map(lambda x: [{"s": s, "e": e} for s, e in slices_of(list(x), size, overlap)])

    # Each row carries its own text only: a copy of all sentences for every chunk would grow with the square of a document.
    cut = docs.select(F.col(id_col).cast("string").alias("document_id"), T.sentences(T.normalize(F.col(text_col))).alias("sentences"))
    spans = cut.withColumn("spans", slices(F.transform("sentences", lambda s: F.length(s))))
    texts = F.transform("spans", lambda x: F.array_join(F.slice("sentences", x["s"] + 1, x["e"] - x["s"]), " "))
    number = F.col("pos") + 1
    return spans.select("document_id", F.posexplode(texts).alias("pos", "text")).select("document_id", number.alias("chunk_no"), T.chunk_id(F.col("document_id"), number).alias("chunk_id"), "text")
