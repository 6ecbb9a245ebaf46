"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ragloom.sources.workers import checkpoint, remove, shared_folder, ship_code

__all__ = ["append_columns", "checkpoint", "first_by_hash", "hot_left_join", "load", "public_path", "remove", "shared_folder", "small_batches"]

#: Rows in one Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 512


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most ``rows`` rows from now on; a smaller setting of the session stays."""
    ship_code(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def append_columns(docs: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: str) -> DataFrame:
    """``docs`` with further columns made from its texts; rows never leave their task.

    ``make`` runs once a task and gives the function for its batches. All columns pass
    through by position, so their names may be any, even twice the same.
    """
    small_batches(docs.sparkSession)
    own, more = docs.schema.fields, StructType.fromDDL(fields).fields
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(own))])
    plain = plain.withColumn(f"_c{at}", F.col(f"_c{at}").cast("string"))
    kinds = StructType([*plain.schema.fields, *[f.__class__(f"_c{len(own) + i}", f.dataType) for i, f in enumerate(more)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch.column(at))], names=kinds.names)

    return plain.mapInArrow(run, kinds).toDF(*[f.name for f in own], *[f.name for f in more])


#: A key of a join is hot from this many rows on, and from a thousandth of all rows on; the
#: parts into which its rows are dealt.
HOT, SALTS = 50_000, 64


def hot_left_join(left: DataFrame, right: DataFrame, on: list[str], sizes: DataFrame, hot: int = HOT) -> DataFrame:
    """Left join whose keys may be hot on the left; ``right`` has one row a key.

    ``sizes`` has the keys and ``n``, the rows that ``left`` has of each. Only hot keys
    are salted: their left rows take one of ``SALTS`` salts from a hash of their own
    columns, their right row is repeated for each. Hot keys hold a thousandth of all
    rows, so there are a thousand at most, and these are broadcast.
    """
    salt, salts = "_salt_of_join", "_salts_of_join"
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = F.broadcast(sizes.where(F.col("n") >= max(hot, total // 1000)).select(*on, F.lit(SALTS).alias(salts)))
    own = [F.col(f"`{c}`") for c in left.columns]
    spread = left.join(large, on, "left").withColumn(salt, F.when(F.col(salts).isNull(), 0).otherwise(F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int"))).drop(salts)
    copied = right.join(large, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(salts)
    return spread.join(copied, [*on, salt], "left").drop(salt)


def first_by_hash(rows: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, those of the smallest hashes of a key that no two rows share.

    A threshold from the known number of rows leaves about as many as are wanted before
    anything is ordered, so no task or driver sees ``most`` rows of every partition.
    """
    n = rows.count()
    place = F.xxhash64(F.lit(seed), F.col(key))
    if n > most:
        part = min(1.0, (most + 6 * most**0.5 + 10) / n)
        rows = rows.where(place <= F.lit(-(2**63) + int(part * (2**64 - 1)) if part < 1 else 2**63 - 1))
    return rows.orderBy(place, key).limit(most)


def public_path(name: str) -> str:
    """Where the installed vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
