"""People against models, and the two halves of a pair under a prompt that demands the script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qiyas.functions import text
from qiyas.functions.text import MODES
from qiyas.operators.scoring import COVERAGE, RUN, score_table, scored
from qiyas.operators.statistics import bootstrap_hash, bootstrap_hashes, compared, holm


def human_scores(items: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers of a person to known items, scored like a model's; blank ones are wrong, as a model's are. items(item_id, category, golds), answers(item_id, answer)."""
    both = items.join(answers.select("item_id", F.col("answer").alias("raw_response")), "item_id")
    return scored(both).withColumn("blank", F.trim(F.coalesce("raw_response", F.lit(""))) == "")


def human_table(scores: DataFrame, resamples: int = 1000) -> DataFrame:
    """mode, n, blank, em, low and high of each mode."""
    one = scores.select("item_id", "blank", *[F.col(f"em_{m.name}").alias(m.name) for m in MODES], F.lit(1).alias("_g"))
    drawn = bootstrap_hashes(one, ["_g"], "item_id", [m.name for m in MODES], resamples)
    blank = one.groupBy("_g").agg(F.count_if("blank").alias("blank"))
    each = F.explode(F.array(*[F.struct(F.lit(m.name).alias("mode"), F.col(f"{m.name}_mean").alias("em"), F.col(f"{m.name}_low").alias("low"), F.col(f"{m.name}_high").alias("high")) for m in MODES]))
    return drawn.join(blank, "_g").select("n", "blank", each.alias("x")).select("x.mode", "n", "blank", "x.em", "x.low", "x.high")


def human_by(scores: DataFrame, column: str) -> DataFrame:
    """n and strict EM by category or the like."""
    return scores.groupBy(column).agg(F.count("*").alias("n"), F.avg("em_strict").alias("em"))


def against_models(human: DataFrame, runs: DataFrame, name: str = "human", least: float = COVERAGE) -> DataFrame:
    """name, n, em and best: the person and every model on the items that the person answered, in the last mode.

    runs: output of ``scored``; runs in az of the default style count, if they have ``least`` of the items. best is whether
    no model is above the person.
    """
    em = f"em_{MODES[-1].name}"
    ids = human.select("item_id").distinct()
    size = ids.agg(F.count("*").alias("_all"))  # one row
    of = runs.where("language = 'az' and prompt_style = 'default'").join(ids, "item_id", "left_semi")
    models = of.groupBy("model").agg(F.count("*").alias("n"), F.avg(em).alias("em")).join(F.broadcast(size)).where(F.col("n") >= least * F.col("_all"))
    person = human.agg(F.count("*").alias("n"), F.avg(em).alias("em")).where("n > 0")
    top = models.agg(F.coalesce(F.max("em"), F.lit(0.0)).alias("_top"))
    rows = models.select(F.col("model").alias("name"), "n", "em", F.lit(None).cast("boolean").alias("best"))
    return rows.unionByName(person.join(F.broadcast(top)).select(F.lit(name).alias("name"), "n", "em", (F.col("em") > F.col("_top")).alias("best")))


def cells(scores: DataFrame, base: str, tuned: str, styles: tuple[str, str] = ("default", "script")) -> DataFrame:
    """The scores in az of two models under two prompts, on the items that all four runs have, with role. Fails if one of them is missing."""
    role = F.when(F.col("model") == base, "base").when(F.col("model") == tuned, "tuned")
    four = scores.where((F.col("language") == "az") & F.col("prompt_style").isin(*styles)).withColumn("role", role).where("role is not null")
    there = {(r["role"], r["prompt_style"]) for r in four.select("role", "prompt_style").distinct().collect()}  # four rows
    missing = [f"{m} [{s}]" for m, r in ((base, "base"), (tuned, "tuned")) for s in styles if (r, s) not in there]
    if missing:
        raise ValueError(f"runs are missing: {', '.join(missing)}")
    common = four.groupBy("item_id").agg(F.count_distinct("role", "prompt_style").alias("_k")).where("_k = 4").select("item_id")
    return four.join(common, "item_id", "left_semi")


def matrix(four: DataFrame) -> DataFrame:
    """model, prompt_style, n, and EM in the strict and the last mode."""
    return four.groupBy("model", "prompt_style").agg(F.count("*").alias("n"), F.avg("em_strict").alias("em_strict"), F.avg(f"em_{MODES[-1].name}").alias("em_last"))


def ladder(four: DataFrame, resamples: int = 1000) -> DataFrame:
    """model, prompt_style, mode, n, mean, low and high."""
    return bootstrap_hash(score_table(four), ["model", "prompt_style", "mode"], "item_id", "em", resamples)


def _two(four: DataFrame, side: str, a: str, b: str, other: str, resamples: int) -> DataFrame:
    """Each item's scores under side = a and b, compared within ``other`` and mode; all tests are one family."""
    rows = score_table(four).join(four.select(*RUN, "item_id", "role"), [*RUN, "item_id"])
    key = [other, "mode", "mode_order", "item_id"]
    left, right = (rows.where(F.col(side) == x).select(*key, F.col("em").alias(n)) for x, n in ((a, "em_a"), (b, "em_b")))
    out = compared(left.join(right, key), key[:-1], "item_id", "em_a", "em_b", resamples)
    return holm(out.withColumn("_f", F.lit(1)), ["_f"], "p", [other, "mode_order"]).withColumn("significant", F.col("p_holm") < 0.05).drop("_f", "mode_order")


def gap(four: DataFrame, resamples: int = 1000) -> DataFrame:
    """Base less tuned in each style and mode, and the share of the style's strict gap that a mode closes (null if that gap is below 1e-9)."""
    out = _two(four, "role", "base", "tuned", "prompt_style", resamples)
    strict = out.where("mode = 'strict'").select("prompt_style", F.col("diff").alias("_strict"))  # a row a style
    closed = F.when(F.col("mode") == "strict", 0.0).when(F.abs("_strict") >= 1e-9, (F.col("_strict") - F.col("diff")) / F.col("_strict"))
    return out.join(strict, "prompt_style").withColumn("closed", closed).drop("_strict")


def script_effect(four: DataFrame, styles: tuple[str, str] = ("default", "script"), resamples: int = 1000) -> DataFrame:
    """What the prompt that demands the script adds to each model in each mode."""
    return _two(four, "prompt_style", styles[1], styles[0], "model", resamples)


def script_counts(four: DataFrame) -> DataFrame:
    """Answers with Cyrillic letters and without, and the share of the former."""
    out = four.groupBy("model", "prompt_style").agg(F.count("*").alias("n"), F.count_if(text.has_cyrillic(F.col("prediction"))).alias("cyrillic"))
    return out.select("model", "prompt_style", "cyrillic", (F.col("n") - F.col("cyrillic")).alias("latin"), (F.col("cyrillic") / F.col("n")).alias("share"))
