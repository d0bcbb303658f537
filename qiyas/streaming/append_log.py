"""Append-only scoring of a stream of items that can stop and go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qiyas.operators.numbering import numbered
from qiyas.operators.statistics import hash_uniform


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that the log doesn't have yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def answered(items: DataFrame, respond: Callable[[DataFrame], DataFrame], failed: str = "failed") -> DataFrame:
    """Responses of a back-end, without the rows that failed, so that a later run tries them again."""
    return respond(items).where(~F.coalesce(failed, F.lit(False))).drop(failed)


def echo(items: DataFrame, key: str) -> DataFrame:
    """A back-end that answers nothing, for runs that test the log alone."""
    return items.select(key, F.lit("").alias("response"), F.lit(False).alias("failed"))


def oracle(items: DataFrame, golds: DataFrame, key: str, accuracy: float = 0.6, seed: int = 0) -> DataFrame:
    """A back-end that knows the golds(key, gold): right in ``accuracy`` of the items by a hash of the key, else with the gold of another row. An item without a gold gets ''."""
    order = numbered(golds.select(key, "gold"), [key], "_n")
    size = order.agg(F.count("*").alias("_size"))  # one row
    u = lambda what: hash_uniform(F.lit(seed), key, F.lit(what))
    asked = items.select(key).join(F.broadcast(size)).withColumns({"_right": u("right") / 2.0**32 < accuracy, "_n": u("other") % F.greatest("_size", F.lit(1))})
    own = asked.join(order.select(key, F.col("gold").alias("_own")), key, "left")
    both = own.join(order.select("_n", F.col("gold").alias("_other")), "_n", "left")
    return both.select(key, F.coalesce(F.when(F.col("_right"), F.col("_own")).otherwise(F.col("_other")), F.lit("")).alias("response"), F.lit(False).alias("failed"))


def run(stream: DataFrame, respond: Callable[[DataFrame], DataFrame], key: str, log: str, checkpoint: str):
    """Answers each item of a stream once and appends to a Parquet log. Returns the started query.

    State holds one id per item; the log itself is read before each append, so a batch that is
    replayed after a failure adds nothing twice.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(log)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        fresh = pending(batch, spark.read.parquet(log), key) if there else batch
        answered(fresh, respond).write.mode("append").parquet(log)

    return stream.dropDuplicates([key]).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
