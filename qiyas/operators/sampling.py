"""Samples, quotas and turns, all in a fixed order of hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qiyas.operators.statistics import hash_uniform


def stratified_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """A proportional sample: of each stratum max(1, half-even rounding of its share) rows in hash order, ``size`` rows at most.

    Ranks are taken within strata; candidates of a stratum are cut by a hash before ranking, so a large stratum isn't
    ranked by one task; the strata's sizes are one row each.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    quota = F.greatest(F.lit(1), F.bround(size * F.col("_n") / F.col("_total")).cast("int"))
    quotas = sizes.join(F.broadcast(total)).select(F.col(stratum).alias("_s"), "_n", quota.alias("_quota"))
    u = hash_uniform(F.lit(seed), key)
    near = df.join(F.broadcast(quotas), F.col(stratum).eqNullSafe(F.col("_s"))).withColumn("_u", u)
    # the cut goes by distinct keys, as copies of a key have one hash
    keys = df.groupBy(F.col(stratum).alias("_s2")).agg(F.count_distinct(key).alias("_k"))
    near = near.join(F.broadcast(keys), F.col("_s").eqNullSafe(F.col("_s2")))
    near = near.where(F.col("_u") / 2.0**32 <= (F.col("_quota") + 10 * F.sqrt("_quota") + 30) / F.greatest("_k", F.lit(1)))
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_u", key))).where("_r <= _quota")
    return ranked.orderBy("_u", key).limit(size).select(*df.columns)


def error_sample(wrong: DataFrame, group: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """Equal quotas of each group, filled up from the rest in hash order to ``size`` rows."""
    groups = wrong.agg(F.count_distinct(group).alias("_groups"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(size) / F.col("_groups")).cast("int"))
    ranked = wrong.join(F.broadcast(groups)).withColumn("_u", hash_uniform(F.lit(seed), key))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_u", key))).withColumn("_first", F.when(F.col("_r") <= quota, 0).otherwise(1))
    return ranked.orderBy("_first", "_u", key).limit(size).select(*wrong.columns)


def quota_top(df: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most)


def round_robin(df: DataFrame, group: list[str], order: list, turns: int) -> DataFrame:
    """Adds turn: rows of each group take the turns one after another."""
    return df.withColumn("turn", (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) % turns)
