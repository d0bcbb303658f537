"""Dense numbers and balanced turns without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qiyas.sources import shared

_LOW = (1 << 33) - 1  # bits of a row's number within its partition in monotonically_increasing_id


def numbered(df: DataFrame, order: list[str | Column], name: str = "number", first: int = 0) -> DataFrame:
    """Adds ``name``: first, first + 1, ... in the given order, without gaps.

    The rows are dealt out by ranges of the order and written once; each range counts its own rows, and a table of one
    row a range holds what stands before it. Rows that are equal in ``order`` get neighbouring numbers in any order, so
    give one without ties where that matters. Nulls stand where the order puts them (first, if plain names are given).
    An empty table stays empty.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place_in_range", F.monotonically_increasing_id())
    rows = shared.written(dealt, "numbered").withColumn("_number_range", F.shiftright("_place_in_range", 33))
    before, total = [], first
    for r in sorted(rows.groupBy("_number_range").agg(F.count("*").alias("n")).collect()):  # one row a partition
        before.append((r["_number_range"], total))
        total += r["n"]
    starts = spark.createDataFrame(before, "_number_range long, _number_before long")
    number = F.col("_number_before") + F.col("_place_in_range").bitwiseAND(F.lit(_LOW))
    return rows.join(F.broadcast(starts), "_number_range").withColumn(name, number).drop("_number_range", "_place_in_range", "_number_before")


def turns(df: DataFrame, order: list[str | Column], n: int, name: str = "turn") -> DataFrame:
    """Adds ``name``: 0 to n - 1 in turn, in the given order over all rows, so that no turn has two rows more than another."""
    return numbered(df, order, name).withColumn(name, (F.col(name) % n).cast("int"))
