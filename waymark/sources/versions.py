"""Versioned tables with an atomic pointer, and checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder name in spark.checkpoint.dir; it goes when the application ends.

    Where that setting is absent and Spark runs on one machine, as in tests, a temporary
    folder is used; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    store, at = _path(spark, path)
    store.deleteOnExit(at)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, lineage cut.

    `dropped` deletes the table when no plan reads it any more; what is left goes when the
    application ends.
    """
    path = new_path(df.sparkSession, "step")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.step_path = path
    return out


def dropped(*steps: DataFrame | None) -> None:
    """Deletes the tables of `checkpointed` frames."""
    for df in steps:
        if df is not None and getattr(df, "step_path", None):
            store, at = _path(df.sparkSession, df.step_path)
            store.delete(at, True)


class Versions:
    """A table as numbered folders; the newest with a finished write is current.

    A write that fails leaves the old version current: a folder counts only once its
    job has committed (`_SUCCESS`). Readers keep the version that they opened.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        found = []
        for s in self._fs.listStatus(self._hadoop(self.path)):
            name = s.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and self._fs.exists(self._hadoop(f"{self.path}/{name}/_SUCCESS")):
                found.append(int(name[1:]))
        return sorted(found)

    def write(self, df: DataFrame) -> int:
        number = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        return number

    def read(self, number: int | None = None) -> DataFrame:
        own = self.versions()
        if not own:
            raise FileNotFoundError(f"{self.path} has no finished version")
        return self.spark.read.parquet(f"{self.path}/v{number or own[-1]}")
