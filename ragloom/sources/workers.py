"""Python workers: making this package importable for them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_code(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_ragloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="ragloom-")) / "ragloom_code.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(bundle))
    sc._ragloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A temporary folder stands in for it in local mode only; elsewhere a missing setting
    is an error, since a machine's own folder is lost with the machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ragloom-"))
    return sc.getCheckpointDir()


#: Spark's setting that deletes a query's shuffle files when it is done.
CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame, *, clear: bool = False) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor loses nothing.

    With ``clear`` the files that were shuffled for it are deleted at once instead of when
    the driver next collects garbage; nothing reads them again.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not clear:
        return df.checkpoint()
    before = spark.conf.get(CLEAR, None)
    spark.conf.set(CLEAR, "true")
    try:
        return df.select("*").checkpoint()  # the setting holds for plans that are made under it
    finally:
        spark.conf.unset(CLEAR) if before is None else spark.conf.set(CLEAR, before)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    place, system = _place(spark, path)
    system.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Move a folder to the place of another, which is deleted last."""
    (source, system), (target, _), (aside, _) = (_place(spark, p) for p in (new, old, f"{old}_old"))
    system.delete(aside, True)
    if system.exists(target) and not system.rename(target, aside):
        raise OSError(f"{old} can't be set aside")
    if not system.rename(source, target):
        raise OSError(f"{new} can't be moved to {old}")
    system.delete(aside, True)
