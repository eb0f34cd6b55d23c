"""Tables in the folder that all executors share, which cut the lineage of long plans."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Folders of this process's tables, removed when it ends.
_ROOTS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only a session on one machine, as in tests, may leave it unset: it gets a temporary
    one. On a cluster each executor would write to a disk of its own, so that is refused.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share; the master is {master}")
        path = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set(CHECKPOINT_KEY, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def remove(path: str) -> None:
    jvm = SparkContext._jvm
    if jvm is not None:
        there = jvm.org.apache.hadoop.fs.Path(path)
        context = SparkContext._active_spark_context
        conf = context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
        there.getFileSystem(conf).delete(there, True)


def _remove_all() -> None:
    with contextlib.suppress(Py4JError, OSError):
        for root in _ROOTS:
            remove(root)


class Scratch:
    """Tables written once, so that a lost executor costs no recomputation.

    ``drop`` removes a table that no later plan reads. The others are part of lazy
    results and are removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex[:12]}"
        if not _ROOTS:
            # After the session's own handlers, so that it runs before them.
            atexit.register(_remove_all)
        _ROOTS.append(self.root)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table and reads it back."""
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def keep_counted(self, name: str, df: DataFrame) -> tuple[DataFrame, int]:
        """The same, and how many rows were written; the count needs no job of its own."""
        seen = Observation()
        return self.keep(name, df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]

    def drop(self, name: str) -> None:
        remove(f"{self.root}/{name}")
