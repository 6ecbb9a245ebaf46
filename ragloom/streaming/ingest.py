"""Incremental ingest: an extension, for corpora that grow by new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ragloom.operators.chunking import chunk_texts


def chunk_stream(spark: SparkSession, source: str, schema: str, target: str, state: str, id_col: str, text_col: str, size: int = 1000, overlap: int = 150) -> StreamingQuery:
    """Chunks of the Parquet files that are new in ``source``, appended to ``target``.

    ``state`` is the query's checkpoint folder. A micro-batch is written under its own
    number, so one that runs again after a failure replaces what it had written.
    """
    read = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        chunk_texts(batch, id_col, text_col, size, overlap).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return read.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
