"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="qiyas-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Parquet tables that cut lineage; each survives the loss of any executor.

    The folder goes when the application ends, or earlier with ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        files = self._path("").getFileSystem(self._conf())
        files.mkdirs(self._path(""))  # only a folder that exists is noted
        files.deleteOnExit(self._path(""))

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows once and returns a reader of them. Shuffles of finished steps needn't stay on disk meanwhile."""
        df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        gc.collect()
        self.spark._jvm.System.gc()  # Spark's cleaner removes shuffles whose plans are gone
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(name)
            path.getFileSystem(self._conf()).delete(path, True)


def free_name(name: str, columns: list[str]) -> str:
    """A name that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
