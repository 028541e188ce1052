"""Tables that cut lineage, in the folder that the cluster names in spark.checkpoint.dir.

Every table is written as Parquet and read back, so a lost executor costs only the task that
it ran: what was computed before the cut is on shared storage.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[Scratch] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="siftwise-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """One operator's intermediate tables. They go when dropped, or at the driver's end."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.count = spark, 0
        self.root = f"{shared_root(spark)}/siftwise-{label}-{uuid.uuid4().hex}"
        if not _OPEN:
            atexit.register(_close_all)
        _OPEN.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        """The rows of df, stored; the result reads the stored files."""
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored._scratch_path = path
        return stored

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that save() returned; nothing may read them later."""
        for table in tables:
            if table is not None:
                self._delete(table._scratch_path)

    def release(self) -> None:
        """Lets Spark delete shuffle files whose DataFrames are gone, before more are written."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)


def _close_all() -> None:
    for scratch in _OPEN:
        with contextlib.suppress(Exception):  # the session may have ended before
            scratch._delete(scratch.root)
