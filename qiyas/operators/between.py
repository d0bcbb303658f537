"""Between declared pairs: which account of the damage fits, tested by exact permutations over pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qiyas.operators.statistics import counted_arrangements

# fixed values: families by a part of the base model's name, targets related to Azerbaijani, points of change that count as strong, fewest pairs
FAMILIES = ("qwen", "gemma", "llama", "mistral", "phi", "falcon")
OTHER_FAMILY = "digər"
RELATED = ("qazax", "türk")
STRONG = 3.5
FEWEST_PAIRS = 4
# end of fixed values
#: The styles of a pair in order of preference, for each rule.
STYLE_RULES = {"default first": ("default", "oneshot"), "oneshot first": ("oneshot", "default")}


def base_family(name: Column) -> Column:
    """The family that the last part of a model's name belongs to: the first of FAMILIES that occurs in it."""
    last = F.lower(F.element_at(F.split(name, "/"), -1))
    out = F.when(F.lit(False), "")
    for f in FAMILIES:
        out = out.when(last.contains(f), f.capitalize())
    return out.otherwise(OTHER_FAMILY)


def damaged() -> Column:
    """Whether az is damaged: the excess is surely above 0, and az itself fell."""
    return (F.col("low") > 0) & (F.col("az_loss") > 0)


def accounts() -> dict[str, Column]:
    """What each account says of a pair: that damage is expected. Losses are in points."""
    return {
        "script": F.col("script") == "kiril",
        "base family": F.col("base_family") == "Qwen",
        "strength": F.abs("az_loss") + F.abs("en_loss") > STRONG,
        "kinship": F.col("target").isin(*RELATED),
    }


def preferred(measured: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row a label: that of the first style in ``order`` which was measured, whatever its numbers. Other styles don't count."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("prompt_style"))
    rest = [c for c in measured.columns if c != "label"]
    best = measured.where(place > 0).groupBy("label").agg(F.min_by(F.struct(*rest), place).alias("_row"))
    return best.select("label", "_row.*")


def exact_tests(rows: DataFrame, group: Sequence[str], key: str, value: str, inside: str) -> DataFrame:
    """observed, p_mean, rank_diff, p_rank and arrangements of each group: differences in means and in mean ranks over all ways to choose as many rows.

    Equal values have the rank of the first of them. A group is a set of declared pairs or the like, small by its nature: exact p-values
    of more rows than some forty aren't asked for. Groups with all or no rows inside can't be tested and give none. arrangements is null beyond 63 bits.
    """
    names = list(group)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)

    def test(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        values, flags = table.column(value).to_pylist(), table.column(inside).to_pylist()
        head = table.select(names).slice(0, 1)
        if not 0 < sum(flags) < len(flags):
            empty = [pa.array([], t) for t in (pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())]
            return pa.table([*head.slice(0, 0).columns, *empty], [*names, "observed", "p_mean", "rank_diff", "p_rank", "arrangements"])
        first: dict[float, int] = {}
        for place, v in enumerate(sorted(values)):
            first.setdefault(v, place + 1)
        observed, p_mean, n = counted_arrangements(values, flags)
        rank_diff, p_rank, _ = counted_arrangements([float(first[v]) for v in values], flags)
        cells = [pa.array([x], pa.float64()) for x in (observed, p_mean, rank_diff, p_rank)] + [pa.array([n if n < 1 << 63 else None], pa.int64())]
        return pa.table([*head.columns, *cells], [*names, "observed", "p_mean", "rank_diff", "p_rank", "arrangements"])

    few = rows.select(*names, key, F.col(value).cast("double").alias(value), F.col(inside).cast("boolean").alias(inside))
    return few.groupBy(*names).applyInArrow(test, f"{kind}, observed double, p_mean double, rank_diff double, p_rank double, arrangements long")


def test_accounts(rows: DataFrame, group: Sequence[str] = (), rules: Mapping[str, Column] | None = None) -> DataFrame:
    """account, pairs, correct (pairs whose damage it foretells), and the exact tests of the excess between the pairs it marks and the others.

    rows(label, excess, low, az_loss, en_loss, script, base_family, target). Accounts that mark all pairs or none are left out.
    """
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("account"), F.coalesce(c, F.lit(False)).alias("inside")) for k, c in (rules or accounts()).items()]))
    each = rows.select(*group, "label", "excess", damaged().alias("damaged"), said.alias("x")).select(*group, "label", "excess", "damaged", "x.*")
    key = [*group, "account"]
    counted = each.groupBy(*key).agg(F.count("*").alias("pairs"), F.count_if(F.col("inside") == F.col("damaged")).alias("correct"))
    return counted.join(exact_tests(each, key, "label", "excess", "inside"), key)


def sensitivity(measured: DataFrame, rules: Mapping[str, Sequence[str]] = STYLE_RULES, asked: Sequence[str] = ("script", "base family"), fewest: int = FEWEST_PAIRS) -> DataFrame:
    """How far the accounts hang on the choice of style: rule, account, pairs, correct and p_mean; rules with fewer than ``fewest`` pairs are left out."""
    chosen = None
    for name, order in rules.items():
        rows = preferred(measured, order).withColumn("rule", F.lit(name))
        chosen = rows if chosen is None else chosen.unionByName(rows)
    only = {k: c for k, c in accounts().items() if k in asked}
    tested = test_accounts(chosen, ["rule"], only).where(F.col("pairs") >= fewest)
    # a rule counts only if all that was asked could be tested
    whole = tested.groupBy("rule").agg(F.count("*").alias("_n")).where(F.col("_n") == len(only)).select("rule")
    return tested.join(whole, "rule", "left_semi").select("rule", "account", "pairs", "correct", "p_mean")


def confound(rows: DataFrame) -> DataFrame:
    """One row: how many pairs are damaged, of how many base families they are, and whether these are all one, so that script and family can't be told apart."""
    hit = rows.where(damaged())
    return hit.agg(F.count("*").alias("damaged"), F.count_distinct("base_family").alias("families")).withColumn("one_family", (F.col("damaged") > 0) & (F.col("families") == 1))
