"""A keyed table that a stream of edits keeps up to date, as versioned snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """Folders ``version=N`` under a path, of which the latest published one counts.

    A snapshot is written under a name of its own and published by one rename, so a reader sees the version before it or all of it. What a batch left
    behind that stopped half-way is never read. Versions are batch numbers: a batch that was published before isn't published again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def latest(self) -> int | None:
        """The published version, if any."""
        files, path = self._files()
        if not files.exists(path):
            return None
        found = [s.getPath().getName() for s in files.listStatus(path)]
        return max((int(n.removeprefix("version=")) for n in found if n.startswith("version=")), default=None)

    def read(self) -> DataFrame | None:
        version = self.latest()
        return None if version is None else self.spark.read.parquet(f"{self.path}/version={version}")

    def write(self, df: DataFrame, version: int) -> str:
        """Writes a snapshot that no one reads yet; returns its folder."""
        folder = f"{self.path}/_writing-{version}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
        return folder

    def publish(self, version: int) -> None:
        """Makes a written snapshot the latest, and deletes those before the one that it follows: readers may still hold that."""
        files, _ = self._files()
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        before = self.latest()
        if not files.rename(at(f"{self.path}/_writing-{version}"), at(f"{self.path}/version={version}")):
            raise RuntimeError(f"version {version} can't be published")
        for s in files.listStatus(at(self.path)):
            name = s.getPath().getName()
            if name.startswith("version=") and before is not None and int(name.removeprefix("version=")) < before:
                files.delete(s.getPath(), True)


def newest(edits: DataFrame, key: str, order: str) -> DataFrame:
    """The last edit of each key in the given order."""
    rest = [c for c in edits.columns if c != key]
    return edits.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(key, "_v.*")


def merged(now: DataFrame | None, edits: DataFrame, key: str, order: str, group: Column, batch: int) -> DataFrame:
    """The table after a batch of edits, with first (the least key of the rows of its group) and checked (the batch that last looked at the group).

    An edit replaces the row of its key unless that row is from a later edit, so edits that come again or late change nothing. Only the groups that a
    changed row has left or joined are looked at again. ``group`` says which rows are duplicates of one another, null for rows that aren't compared.
    """
    fresh = newest(edits, key, order)
    columns = fresh.columns
    if now is None:
        rows = fresh.withColumns({"first": F.lit(None).cast(fresh.schema[key].dataType), "checked": F.lit(batch).cast("long"), "_changed": F.lit(True), "_g": group})
        touched = rows.select("_g")
    else:
        old = now.select(key, F.struct(*now.columns).alias("_old"))
        both = old.join(fresh.select(key, F.struct(*columns).alias("_new")), key, "full_outer")
        takes = F.col("_old").isNull() | (F.col("_new").isNotNull() & (F.col(f"_new.{order}") > F.col(f"_old.{order}")))
        value = lambda c: F.when(takes, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
        rows = both.select(*[value(c) for c in columns], F.when(~takes, F.col("_old.first")).alias("first"), F.when(takes, F.lit(batch)).otherwise(F.col("_old.checked")).cast("long").alias("checked"), takes.alias("_changed")).withColumn("_g", group)
        left = now.withColumn("_g", group).join(rows.where("_changed").select(key), key, "left_semi").select("_g")
        touched = left.union(rows.where("_changed").select("_g"))
    touched = touched.where("_g is not null").distinct().withColumn("_again", F.lit(True))
    marked = rows.join(touched, "_g", "left")
    least = marked.where("_again").groupBy("_g").agg(F.min(key).alias("_first"))
    found = marked.join(least, "_g", "left")
    first = F.when(F.col("_again"), F.col("_first")).when(F.col("_changed"), F.col(key)).otherwise(F.col("first"))
    return found.select(*columns, first.alias("first"), F.when(F.col("_again"), F.lit(batch).cast("long")).otherwise(F.col("checked")).alias("checked"))


def run(stream: DataFrame, key: str, order: str, group: Callable[[], Column], path: str, checkpoint: str):
    """Merges a stream of edits into the snapshots under a path. Returns the started query."""

    def merge(batch: DataFrame, number: int) -> None:
        table = Snapshots(batch.sparkSession, path)
        last = table.latest()
        if last is not None and number <= last:
            return  # published before the stream stopped
        table.write(merged(table.read(), batch, key, order, group(), number), number)
        table.publish(number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
