"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .sources.storage import file_system


def build_session(app: str = "terrane", cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session in one process (tests) gets a temporary folder, kept for the session. On a cluster
    that is an error: every machine would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="terrane-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of one operator inside the shared folder; it goes when the session's process ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    fs, p, _ = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


class Scratch:
    """Tables of one run, written to the shared folder: lineage ends there, and plans see their true sizes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, work_dir(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:04d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        """Delete the n-th table, which nothing may read any more."""
        fs, p, _ = file_system(self.spark, f"{self.path}/{n:04d}")
        fs.delete(p, True)

    def result(self, df: DataFrame) -> DataFrame:
        """Write the last table of a run and delete all others."""
        out = self.put(df)
        for n in range(1, self.n):
            self.drop(n)
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
