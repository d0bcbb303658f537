"""Resampling, exact tests, corrections and agreement, grouped and without collecting rows."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from qiyas.operators import dealing
from qiyas.sources import shared

RESAMPLES, PERMUTATIONS, CONFIDENCE = 1000, 10_000, 0.95


def hash_uniform(*parts: Column | str) -> Column:
    """A whole number below 2**32 from the md5 of the parts: the same on every engine."""
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def holm(df: DataFrame, family: list[str], p: str, order: list[str]) -> DataFrame:
    """Adds p_holm: in each family p times the tests not yet passed, cumulated to a maximum, 1 at most. Ties keep ``order``."""
    w = Window.partitionBy(*family)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(p, *order))).withColumn("_n", F.count("*").over(w))
    step = F.least(F.lit(1.0), (F.col("_n") - F.col("_r") + 1) * F.col(p))
    running = w.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("p_holm", F.max(step).over(running)).drop("_r", "_n")


def log_factorials(most: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])


def sign_flip_exact(discordant: Column, net: Column) -> Column:
    """Two-sided p of a sign-flip test of differences -1, 0 and 1: the tails of a fair binomial, in logarithms."""
    m, d = discordant.cast("long"), F.abs(net).cast("long")
    high = ((m + d) / 2).cast("long")
    # ln m! - ln k! - ln (m-k)! - m ln 2, summed over k >= high
    log_term = lambda k: F.expr("0D") + log_gamma(m + 1) - log_gamma(k + 1) - log_gamma(m - k + 1) - m * F.log(F.lit(2.0))
    tail = F.aggregate(F.transform(F.sequence(high, m), lambda k: F.exp(log_term(k))), F.lit(0.0), lambda a, x: a + x)
    return F.when(d == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def log_gamma(x: Column) -> Column:
    """ln of (x - 1)! for whole x >= 1: exact products below 20, Stirling's series above."""
    x = x.cast("double")
    small = F.log(F.factorial((x - 1).cast("int")).cast("double"))
    big = (x - 0.5) * F.log(x) - x + 0.5 * F.log(F.lit(2 * np.pi)) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(x <= 20, small).otherwise(big)


def paired_summary(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """n, means, difference, discordant pairs and the exact sign-flip p of 0/1 scores."""
    diff = F.col(a) - F.col(b)
    out = pairs.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(diff).alias("diff"),
        F.sum(F.when(diff != 0, 1).otherwise(0)).alias("discordant"), F.sum(diff).cast("long").alias("net"),
    )
    return out.withColumn("p", sign_flip_exact(F.col("discordant"), F.col("net")))


def bootstrap_hash(df: DataFrame, group: list[str], key: str, value: str, resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = 0) -> DataFrame:
    """n, mean, low and high: see ``bootstrap_hashes``."""
    drawn = bootstrap_hashes(df, group, key, [value], resamples, confidence, seed)
    return drawn.withColumnsRenamed({f"{value}_mean": "mean", f"{value}_low": "low", f"{value}_high": "high"})


def bootstrap_hashes(df: DataFrame, group: list[str], key: str, values: list[str], resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = 0) -> DataFrame:
    """n, and mean, low and high of each value: a percentile bootstrap whose draws come from md5.

    Rows are numbered from 0 within their group in the order of the key; draw i of resample r is the row numbered hash(seed, r, i) mod n. The draws are
    dealt out by the row that they hit, how often a resample hits a row is its weight there, and weighted values add up by (group, resample) in
    any number of tasks. No group is held by one row or task. ``bootstrap`` does without numbers and draws.
    """
    w = Window.partitionBy(*group)
    rows = df.select(*group, *[F.col(v).alias(f"_x{k}") for k, v in enumerate(values)], (F.row_number().over(w.orderBy(key)) - 1).cast("long").alias("_i"), F.count("*").over(w).alias("n"))
    drawn = rows.select(*group, "n", "_i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_r"))
    hits = drawn.select(*group, "_r", (hash_uniform(F.lit(seed), "_r", "_i") % F.col("n")).alias("_i")).groupBy(*group, "_i", "_r").agg(F.count("*").alias("_w"))
    sums = hits.join(rows, [*group, "_i"]).groupBy(*group, "n", "_r").agg(*[F.sum(F.col("_w") * F.col(f"_x{k}")).alias(f"_x{k}") for k in range(len(values))])
    tail = (1 - confidence) / 2
    q = lambda k, x: F.percentile(F.col(f"_x{k}") / F.col("n"), F.lit(x))
    bounds = sums.groupBy(*group).agg(*[q(k, x).alias(f"{v}_{name}") for k, v in enumerate(values) for name, x in (("low", tail), ("high", 1 - tail))])
    return df.groupBy(*group).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"{v}_mean") for v in values]).join(bounds, group)


def poisson_thresholds() -> list[int]:
    """Whole numbers t0 < t1 < ...: a uniform u below 2**32 has the weight k of a Poisson variable of mean 1 if k of them are at most u."""
    out, term, total = [], Fraction(1), Fraction(1)
    e = sum(Fraction(1, math.factorial(k)) for k in range(40))
    while (t := int(total / e * 2**32)) < 2**32 - 1:
        out.append(t)
        term /= len(out)
        total += term
    return out


def poisson_weight(u: Column) -> Column:
    """The weight of a row by a uniform number below 2**32."""
    tops = poisson_thresholds()
    out = F.when(u < tops[0], 0)
    for k, t in enumerate(tops[1:], 1):
        out = out.when(u < t, k)
    return out.otherwise(len(tops))


def _hash_parts(seed: int, key: list[str], block: str) -> Column:
    """The md5 of (seed, block, key): 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(block).cast("string"), *[F.col(k).cast("string") for k in key]))


def bootstrap(df: DataFrame, group: list[str], key: list[str], values: list[str], resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of means by weights: in each resample a row counts as often as a Poisson variable of mean 1 says.

    The weight comes from the md5 of the row's key and the resample, so it needs no other row: each task sums weights and weighted
    values of its rows, and these sums add up by (group, resample). Nothing holds a group, and rows of one key (the two scores of an
    item, or an item in several groups) share their weights. Gives n, and <value>_mean, <value>_low and <value>_high of each value.
    A resample in which all weights are 0 doesn't count.
    """
    blocks = -(-resamples // 4)  # an md5 gives the weights of four resamples
    hashed = df.select(*group, *key, *values, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b")).withColumn("_h", _hash_parts(seed, key, "_b"))
    part = F.explode(F.sequence(F.lit(0), F.least(F.lit(3), F.lit(resamples - 1) - 4 * F.col("_b")))).alias("_p")
    weighed = hashed.select(*group, *values, "_b", "_h", part).select(*group, *values, (4 * F.col("_b") + F.col("_p")).alias("_r"), poisson_weight(F.conv(F.substring("_h", 8 * F.col("_p") + 1, F.lit(8)), 16, 10).cast("long")).alias("_w"))
    drawn = weighed.groupBy(*group, "_r").agg(F.sum("_w").alias("_n"), *[F.sum(F.col("_w") * F.col(v)).alias(v) for v in values])
    tail = (1 - confidence) / 2
    mean = lambda v: F.when(F.col("_n") > 0, F.col(v) / F.col("_n"))
    bounds = drawn.groupBy(*group).agg(*[F.percentile(mean(v), F.lit(x)).alias(f"{v}_{name}") for v in values for name, x in (("low", tail), ("high", 1 - tail))])
    whole = df.groupBy(*group).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"{v}_mean") for v in values])
    return whole.join(bounds, group)


def permutation(pairs: DataFrame, group: list[str], key: list[str], a: str, b: str, permutations: int = PERMUTATIONS, seed: int = 0) -> DataFrame:
    """Two-sided sign-flip test by Monte Carlo: p = (hits + 1) / (permutations + 1), with n and the mean difference.

    The sign of a row in a permutation is one digit of an md5 of its key: below 8 it stays. Signed sums of tasks add up by (group, permutation).
    Rows without a difference have no sign and aren't moved.
    """
    width = 32  # signs that an md5 gives
    rows = pairs.select(*group, *key, (F.col(a) - F.col(b)).alias("_d"))
    whole = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg("_d").alias("diff"), F.sum("_d").alias("_sum"))
    hashed = rows.where("_d <> 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-permutations // width) - 1))).alias("_b")).withColumn("_h", _hash_parts(seed, key, "_b"))
    digit = F.explode(F.sequence(F.lit(0), F.least(F.lit(width - 1), F.lit(permutations - 1) - width * F.col("_b")))).alias("_p")
    signed = hashed.select(*group, "_d", "_b", "_h", digit).select(*group, (width * F.col("_b") + F.col("_p")).alias("_r"), F.when(F.substring("_h", F.col("_p") + 1, F.lit(1)) < "8", F.col("_d")).otherwise(-F.col("_d")).alias("_d"))
    sums = signed.groupBy(*group, "_r").agg(F.sum("_d").alias("_s")).join(whole.select(*group, "n", "_sum"), group)
    hits = sums.groupBy(*group).agg(F.count_if(F.abs("_s") / F.col("n") >= F.abs("_sum") / F.col("n") - 1e-12).alias("_hits"))
    # a group without differences is hit by every permutation
    return whole.join(hits, group, "left").select(*group, "n", "diff", ((F.coalesce("_hits", F.lit(permutations)) + 1) / (permutations + 1)).alias("p"))


def with_interval(out: DataFrame, pairs: DataFrame, group: list[str], key: str, a: str, b: str, resamples: int = RESAMPLES) -> DataFrame:
    """Adds low and high of the difference a - b: a percentile bootstrap in which both scores of an item are drawn together."""
    drawn = bootstrap_hash(pairs.withColumn("_d", F.col(a) - F.col(b)), group, key, "_d", resamples)
    return out.join(drawn.select(*group, "low", "high"), group)


def compared(pairs: DataFrame, group: list[str], key: str, a: str, b: str, resamples: int = RESAMPLES) -> DataFrame:
    """n, means, difference with its interval, and the exact sign-flip p of 0/1 scores."""
    return with_interval(paired_summary(pairs, group, a, b), pairs, group, key, a, b, resamples)


def bootstrap_numpy(df: DataFrame, group: list[str], key: str, value: str, resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = 0) -> DataFrame:
    """The same with NumPy's generator, for numbers that other tools made from a seed; a group is drawn in chunks of resamples."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*group).schema.fields) + ", n long, mean double, low double, high double"

    def run(pdf):
        x = pdf.sort_values(key)[value].to_numpy(float)
        rng, means, tail = np.random.default_rng(seed), [], (1 - confidence) / 2
        step = max(1, (1 << 22) // len(x))
        for r in range(0, resamples, step):
            means.append(x[rng.integers(0, len(x), size=(min(step, resamples - r), len(x)))].mean(axis=1))
        low, high = np.quantile(np.concatenate(means), [tail, 1 - tail])
        return pdf[group].head(1).assign(n=len(x), mean=x.mean(), low=low, high=high)

    return df.groupBy(*group).applyInPandas(run, schema)


def permutation_numpy(pairs: DataFrame, group: list[str], key: str, a: str, b: str, permutations: int = PERMUTATIONS, seed: int = 0) -> DataFrame:
    """Two-sided sign-flip test by Monte Carlo: p = (hits + 1) / (permutations + 1)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*group).schema.fields) + ", n long, diff double, p double"

    def run(pdf):
        d = (pdf.sort_values(key)[a] - pdf.sort_values(key)[b]).to_numpy(float)
        rng, hits, observed = np.random.default_rng(seed), 0, abs(d.mean())
        step = max(1, (1 << 22) // len(d))
        for r in range(0, permutations, step):
            signs = rng.choice((-1.0, 1.0), size=(min(step, permutations - r), len(d)))
            hits += int((abs((signs * d).mean(axis=1)) >= observed - 1e-12).sum())
        return pdf[group].head(1).assign(n=len(d), diff=d.mean(), p=(hits + 1) / (permutations + 1))

    return pairs.groupBy(*group).applyInPandas(run, schema)


def subset_sums(values: list[int]) -> list[dict[int, int]]:
    """For each size, the sums of the subsets of that size and how many have each."""
    out: list[dict[int, int]] = [{0: 1}]
    for v in values:
        out.append({})
        for size in range(len(out) - 1, 0, -1):
            for total, count in out[size - 1].items():
                out[size][total + v] = out[size].get(total + v, 0) + count
    return out


def counted_arrangements(values: list[float], inside: list[bool], tolerance: float = 1e-9) -> tuple[float, float, int]:
    """observed, p and arrangements of the difference in means; every arrangement counts, none is listed.

    Values are taken as whole multiples of a power of two, so sums are exact. Both halves of the values give the sums of
    their subsets, which meet sorted: any number of values with few sums, some forty without equal sums.
    """
    n, k = len(values), sum(inside)
    if k in (0, n):
        raise ValueError("an exact test needs rows inside and outside")
    exact = [Fraction(v) for v in values]
    scale = max(f.denominator for f in exact)
    x = [int(f * scale) for f in exact]
    total, here = sum(x), sum(v for v, g in zip(x, inside, strict=True) if g)
    # the difference in means is (sum inside * n - total * k) / (k * (n - k) * scale)
    least = abs(here * n - total * k) - Fraction(tolerance) * k * (n - k) * scale
    high, low = math.ceil((least + total * k) / n), math.floor((total * k - least) / n)
    arrangements = hits = math.comb(n, k)
    if least > 0:
        hits, left, right = 0, subset_sums(x[: n // 2]), subset_sums(x[n // 2 :])
        for size, sums in enumerate(left):
            if not 0 <= k - size < len(right):
                continue
            others = sorted(right[k - size].items())
            keys, upto = [s for s, _ in others], [0, *accumulate(c for _, c in others)]
            for s, count in sums.items():
                hits += count * (upto[-1] - upto[bisect_left(keys, high - s)] + upto[bisect_right(keys, low - s)])
    return float(Fraction(here * n - total * k, k * (n - k) * scale)), float(Fraction(hits, arrangements)), arrangements


def exact_permutation(rows: DataFrame, key: str, value: str, inside: str) -> DataFrame:
    """observed, p and arrangements of the difference in means over all ways to choose the group.

    One small group by its nature: its values go to one task as an array. arrangements is null beyond 63 bits; p stays exact.
    """
    one = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), F.col(inside).cast("boolean").alias("g")))).alias("_v"))
    few = one.select(F.transform("_v", lambda v: v["v"]).alias("v"), F.transform("_v", lambda v: v["g"]).alias("g"))

    def run(batches):
        for batch in batches:
            for values, group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                observed, p, n = counted_arrangements(values, group)
                yield pa.RecordBatch.from_arrays([pa.array([observed]), pa.array([p]), pa.array([n if n < 1 << 63 else None], pa.int64())], ["observed", "p", "arrangements"])

    return few.mapInArrow(run, "observed double, p double, arrangements long")


def mean_ranks(rows: DataFrame, value: str, inside: str) -> DataFrame:
    """Difference of mean ranks, ties at their first place."""
    r = rows.withColumn("_r", F.rank().over(Window.orderBy(value)))
    return r.agg((F.avg(F.when(F.col(inside), F.col("_r"))) - F.avg(F.when(~F.col(inside), F.col("_r")))).alias("rank_diff"))


def cohen_kappa(rows: DataFrame, group: list[str], first: str, second: str) -> DataFrame:
    """n, agreement and kappa of two label columns; NaN if chance agreement is complete. Only label counts are moved."""
    cells = rows.groupBy(*group, F.col(first).alias("_a"), F.col(second).alias("_b")).agg(F.count("*").alias("_n"))
    # the pairs of labels of a group
    maps = cells.groupBy(*group).agg(F.collect_list(F.struct("_a", "_b", "_n")).alias("_c"), F.sum("_n").alias("n"), F.sum(F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("_n")).otherwise(0)).alias("_same"))
    total = lambda side, label: F.aggregate(F.filter("_c", lambda c: c[side].eqNullSafe(label)), F.lit(0).cast("long"), lambda acc, c: acc + c["_n"])
    labels = F.array_distinct(F.concat(F.transform("_c", lambda c: c["_a"]), F.transform("_c", lambda c: c["_b"])))
    chance = F.aggregate(labels, F.lit(0.0), lambda acc, x: acc + (total("_a", x) * total("_b", x)).cast("double")) / (F.col("n") * F.col("n"))
    out = maps.select(*group, "n", (F.col("_same") / F.col("n")).alias("agreement"), chance.alias("_e"))
    return out.select(*group, "n", "agreement", F.when(F.col("_e") == 1, F.lit(float("nan"))).otherwise((F.col("agreement") - F.col("_e")) / (1 - F.col("_e"))).alias("kappa"))


def interpret_kappa(k: Column) -> Column:
    # fixed values: bands of agreement
    bands = ((0.20, "slight"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial"))
    # end of fixed values
    out = F.when(F.isnan(k), "undefined").when(k < 0, "poor")
    for top, name in bands:
        out = out.when(k < top, name)
    return out.otherwise("almost perfect")


def chance_agreement(models: Column, items: Column, options: int = 4) -> Column:
    """Items on which all models choose the same wrong option by chance."""
    return items * (options - 1) * F.pow(F.lit(1.0 / options), models)


def null_shuffle_hash(votes: DataFrame, permutations: int, seed: int = 0, blocks: int = 200, in_arrays: int = 3 << 20) -> DataFrame:
    """Unanimous wrong items in each of many shuffles of the models' votes among their items.

    votes(model, item_id, letter, key). Within a shuffle and model the votes are dealt anew in the order of hashes: the kth vote by hash goes to the
    kth item. The votes are written, packed, and moved once a block of shuffles; a task makes a block's shuffles in arrays. More votes than ``in_arrays``,
    or items that aren't whole numbers, are dealt as rows, which spill: the same result, but far more work.
    """
    n = min(blocks, permutations)
    votes = shared.written(votes.select("model", "item_id", "letter", "key").where("model is not null"), "votes")
    if not isinstance(votes.schema["item_id"].dataType, IntegralType) or votes.count() > in_arrays:
        return _shuffled_rows(votes, permutations, seed, n)
    block = votes.mapInArrow(dealing.packed, "votes binary").select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_b")).repartition(n, "_b")

    def run(key, table):
        rounds = range(key[0].as_py(), permutations, n)
        return pa.table({"round": pa.array(rounds, pa.int32()), "unanimous_wrong": pa.array(dealing.unanimous_wrong(dealing.unpacked(table["votes"]), seed, rounds), pa.int64())})

    return block.groupBy("_b").applyInArrow(run, "round int, unanimous_wrong long")


def _shuffled_rows(votes: DataFrame, permutations: int, seed: int, n: int) -> DataFrame:
    """The shuffles as rows: a block makes its shuffles where it is, and votes meet items there as rows of one group, so no table is broadcast."""
    by_item = F.asc_nulls_last("item_id")
    placed = votes.withColumn("_place", F.row_number().over(Window.partitionBy("model").orderBy(by_item)))
    block = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_b")).repartition(n, "_b")
    rounds = block.withColumn("round", F.explode(F.sequence("_b", F.lit(permutations - 1), F.lit(n))))
    w = Window.partitionBy("_b", "round", "model").orderBy(hash_uniform(F.lit(seed), "round", "model", "item_id"), by_item)
    dealt = rounds.withColumn("_to", F.row_number().over(w))
    of_item = F.struct(F.col("_place").alias("place"), F.col("item_id").alias("item"), "key", F.lit(None).cast("string").alias("letter"))
    of_vote = F.struct(F.col("_to").alias("place"), F.lit(None).cast(votes.schema["item_id"].dataType).alias("item"), F.lit(None).cast("string").alias("key"), "letter")
    both = dealt.select("_b", "round", "model", F.explode(F.array(of_item, of_vote)).alias("x")).select("_b", "round", "model", "x.*")
    new = both.groupBy("_b", "round", "model", "place").agg(*[F.max(c).alias(c) for c in ("item", "key", "letter")])
    each = new.groupBy("_b", "round", "item").agg(F.count("*").alias("n"), F.min("letter").alias("a"), F.max("letter").alias("b"), F.min("key").alias("key"))
    wrong = (F.col("n") >= 2) & (F.col("a") == F.col("b")) & (F.col("a") != F.col("key"))
    return each.groupBy("_b", "round").agg(F.sum(F.when(wrong, 1).otherwise(0)).alias("unanimous_wrong")).drop("_b")
