"""Paired experiments: languages, models and declared pairs compared item by item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qiyas.functions import text
from qiyas.operators import gates
from qiyas.operators.scoring import score_table
from qiyas.operators.statistics import bootstrap_hash, compared, holm, paired_summary, with_interval


def language_gap(scores: DataFrame, a: str = "en", b: str = "az") -> DataFrame:
    """EM of language a less language b for each model, style and mode, one Holm family."""
    s = score_table(scores)
    key = ["model", "prompt_style", "mode", "mode_order", "item_id"]
    left, right = (s.where(F.col("language") == x).select(*key, F.col("em").alias(n)) for x, n in ((a, "em_a"), (b, "em_b")))
    out = paired_summary(left.join(right, key), key[:-1], "em_a", "em_b")
    return holm(out.withColumn("_f", F.lit(1)), ["_f"], "p", ["model", "prompt_style", "mode_order"]).drop("_f", "mode_order")


def model_pairs(scores: DataFrame, language: str, items: DataFrame | None = None) -> DataFrame:
    """All pairs of models of one language and style in each mode; ``items`` restricts them to a stratum."""
    s = score_table(scores.where(F.col("language") == language))
    if items is not None:
        s = s.join(items.select("item_id").distinct(), "item_id", "left_semi")
    key = ["prompt_style", "mode", "mode_order", "item_id"]
    a, b = (s.select(*key, F.col("model").alias(f"model_{x}"), F.col("em").alias(f"em_{x}")) for x in "ab")
    out = paired_summary(a.join(b, key).where("model_a < model_b"), ["model_a", "model_b", *key[:-1]], "em_a", "em_b")
    return holm(out.withColumn("_f", F.lit(1)), ["_f"], "p", ["model_a", "model_b", "prompt_style", "mode_order"]).drop("_f", "mode_order")


def excess_damage(scores: DataFrame, pairs: DataFrame, interval: str = "bootstrap", failed: DataFrame | None = None) -> DataFrame:
    """Loss of the tuned model against its base in each language, and how much more it loses in az.

    pairs(label, base, tuned). Items that any of the four runs lacks don't count. The interval of the excess is the
    percentile bootstrap of its items, or with "normal" the mean and 1.96 standard errors on both sides.
    Pairs that fail a gate in a style, see ``pair_gates``, are left out of it if ``failed`` is given: their numbers are no measurement.
    """
    each = pairs.select("label", F.explode(F.array(F.struct(F.lit("base").alias("role"), F.col("base").alias("model")), F.struct(F.lit("tuned").alias("role"), F.col("tuned").alias("model")))).alias("x")).select("label", "x.*")
    s = scores.select("model", "language", "prompt_style", "item_id", "em_strict", "em_translit", text.has_cyrillic(F.col("prediction")).cast("double").alias("cyrillic")).join(F.broadcast(each), "model")
    cell = lambda role, lang, c: F.max(F.when((F.col("role") == role) & (F.col("language") == lang), F.col(c)))
    four = s.groupBy("label", "prompt_style", "item_id").agg(
        F.count_distinct("role", "language").alias("_cells"), *[cell(r, g, "em_strict").alias(f"{r}_{g}") for r in ("base", "tuned") for g in ("az", "en")],
        cell("base", "az", "em_translit").alias("_bt"), cell("tuned", "az", "em_translit").alias("_tt"), cell("tuned", "az", "cyrillic").alias("_c"),
    ).where("_cells = 4")
    if failed is not None:
        four = four.join(failed.select("label", "prompt_style").distinct(), ["label", "prompt_style"], "left_anti")
    az, en = F.col("base_az") - F.col("tuned_az"), F.col("base_en") - F.col("tuned_en")
    out = four.groupBy("label", "prompt_style").agg(
        F.count("*").alias("n"), F.avg(az).alias("az_loss"), F.avg(en).alias("en_loss"), F.avg(az - en).alias("excess"),
        F.stddev_samp(az - en).alias("_sd"), F.avg(F.col("_bt") - F.col("_tt")).alias("translit_loss"), F.avg("_c").alias("cyrillic_share"),
    )
    if interval == "normal":
        half = 1.96 * F.col("_sd") / F.sqrt("n")
        out = out.withColumns({"low": F.col("excess") - half, "high": F.col("excess") + half})
    else:
        bounds = bootstrap_hash(four.withColumn("_x", az - en), ["label", "prompt_style"], "item_id", "_x")
        out = out.join(bounds.select("label", "prompt_style", "low", "high"), ["label", "prompt_style"])
    fell = F.col("az_loss") > 0  # a verdict on az needs az's own direction
    verdict = (
        F.when((F.col("low") > 0) & fell, "damaged").when(F.col("low") > 0, "gained less")
        .when((F.col("high") < 0) & fell, "lost less").when(F.col("high") < 0, "spared").otherwise("no difference")
    )
    return out.withColumn("verdict", verdict).drop("_sd")


def gap_intervals(scores: DataFrame, a: str = "en", b: str = "az", resamples: int = 1000) -> DataFrame:
    """The strict gap of each model and style with its bootstrap interval."""
    key = ["model", "prompt_style", "item_id"]
    left, right = (scores.where(F.col("language") == x).select(*key, F.col("em_strict").alias(n)) for x, n in ((a, "em_a"), (b, "em_b")))
    return compared(left.join(right, key), key[:-1], "item_id", "em_a", "em_b", resamples)


def pair_intervals(scores: DataFrame, language: str, resamples: int = 1000) -> DataFrame:
    """The strict difference of all pairs of models of a language and style with its bootstrap interval."""
    s = scores.where(F.col("language") == language)
    a, b = (s.select("prompt_style", "item_id", F.col("model").alias(f"model_{x}"), F.col("em_strict").alias(f"em_{x}")) for x in "ab")
    both = a.join(b, ["prompt_style", "item_id"]).where("model_a < model_b")
    return compared(both, ["model_a", "model_b", "prompt_style"], "item_id", "em_a", "em_b", resamples)


def control(scores: DataFrame, items: DataFrame, resamples: int = 1000) -> DataFrame:
    """All pairs of models of a language and style on the items of a stratum, with intervals: az in every mode, en in the strict one, one Holm family."""
    s = score_table(scores).join(items.select("item_id").distinct(), "item_id", "left_semi")
    s = s.where((F.col("language") == "az") | ((F.col("language") == "en") & (F.col("mode") == "strict")))
    key = ["language", "prompt_style", "mode", "mode_order", "item_id"]
    a, b = (s.select(*key, F.col("model").alias(f"model_{x}"), F.col("em").alias(f"em_{x}")) for x in "ab")
    group = ["model_a", "model_b", *key[:-1]]
    out = compared(a.join(b, key).where("model_a < model_b"), group, "item_id", "em_a", "em_b", resamples)
    out = holm(out.withColumn("_f", F.lit(1)), ["_f"], "p", ["language", "model_a", "model_b", "prompt_style", "mode_order"]).drop("_f", "mode_order")
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def usable_styles(rates: DataFrame, most_empty: float = 0.20) -> DataFrame:
    """model and prompt_style of the styles in which both az and en have a run and neither is mostly empty. rates: output of ``gates.rates``."""
    ok = rates.groupBy("model", "prompt_style").agg(F.count_distinct("language").alias("_k"), F.max("empty_rate").alias("_e"))
    return ok.where((F.col("_k") == 2) & (F.col("_e") <= most_empty)).select("model", "prompt_style")


def prompt_verdict(gap: DataFrame, usable: DataFrame) -> DataFrame:
    """A gap holds if its interval lies above 0 in every usable style, two styles at least; gap(model, prompt_style, low)."""
    of = gap.join(usable, ["model", "prompt_style"], "left_semi").groupBy("model").agg(F.count("*").alias("styles"), F.bool_and(F.col("low") > 0).alias("_all"))
    return of.select("model", "styles", F.when(F.col("styles") < 2, F.lit(False)).otherwise(F.col("_all")).alias("holds"))


def pair_gates(rates: DataFrame, pairs: DataFrame) -> DataFrame:
    """label and failures (model, language, style and gate) of the declared pairs of which any half fails a gate in either language.

    The gates of a pair are the echo of examples, the echo of the question and extraction, in this order; empty responses are scored as they are.
    rates: output of ``gates.rates``.
    """
    gate = F.when(F.col("example_echo_rate") > gates.ECHO, "example echo").when(F.col("question_echo_rate") > gates.ECHO, "question echo").when(F.col("recoverable_rate") > gates.RECOVERABLE, "extraction")
    halves = pairs.select("label", F.explode(F.array("base", "tuned")).alias("model"))
    failed = rates.where(F.col("language").isin("az", "en")).withColumn("_gate", gate).where("_gate is not null").join(F.broadcast(halves), "model")
    one = F.concat_ws(" ", "model", "language", "prompt_style", "_gate")
    return failed.groupBy("label", "prompt_style").agg(F.array_join(F.array_sort(F.collect_set(one)), ", ").alias("failures"))


def confirmatory(scores: DataFrame, pairs: DataFrame, resamples: int = 1000) -> DataFrame:
    """Base against tuned of the declared pairs alone, in each language and mode: one Holm family, whatever else was run.

    Items that any of a pair's four runs of a style lacks don't count.
    """
    roles = pairs.select("label", F.explode(F.array(F.struct(F.lit("a").alias("role"), F.col("base").alias("model")), F.struct(F.lit("b").alias("role"), F.col("tuned").alias("model")))).alias("x")).select("label", "x.*")
    s = score_table(scores).join(F.broadcast(roles), "model")
    cell = lambda role, lang: F.max(F.when((F.col("role") == role) & (F.col("language") == lang), F.col("em")))
    four = s.groupBy("label", "prompt_style", "mode", "mode_order", "item_id").agg(*[cell(r, g).alias(f"{r}_{g}") for r in "ab" for g in ("az", "en")]).dropna()
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("language"), F.col(f"a_{g}").alias("em_a"), F.col(f"b_{g}").alias("em_b")) for g in ("az", "en")]))
    rows = four.select("label", "prompt_style", "mode", "mode_order", "item_id", each.alias("x")).select("label", "prompt_style", "mode", "mode_order", "item_id", "x.*")
    out = paired_summary(rows, ["label", "prompt_style", "mode", "mode_order", "language"], "em_a", "em_b")
    out = holm(out.withColumn("_f", F.lit(1)), ["_f"], "p", ["label", "prompt_style", "language", "mode_order"]).drop("_f")
    with_ci = with_interval(out, rows, ["label", "prompt_style", "mode", "mode_order", "language"], "item_id", "em_a", "em_b", resamples)
    return with_ci.withColumn("significant", F.col("p_holm") < 0.05).drop("mode_order")


def gap_closed(gap: DataFrame) -> DataFrame:
    """Share of the strict gap that each further mode closes; null where the strict gap is below 1e-9."""
    w = Window.partitionBy("model", "prompt_style")
    strict = F.max(F.when(F.col("mode") == "strict", F.col("diff"))).over(w)
    return gap.withColumn("closed", F.when(F.abs(strict) >= 1e-9, (strict - F.col("diff")) / strict))


def subset_gaps(scores: DataFrame, universal: list[int]) -> DataFrame:
    """The en - az gap over all items, without the largest category, over a control stratum, and over both."""
    sizes = scores.select("item_id", "category").distinct().groupBy("category").agg(F.count("*").alias("_n"))
    # one row: the largest category, the smaller number among equals
    largest = sizes.orderBy(F.desc("_n"), "category").limit(1).select(F.col("category").alias("_largest"))
    wide = scores.groupBy("model", "prompt_style", "item_id", "category").agg(F.max(F.when(F.col("language") == "en", F.col("em_strict"))).alias("e"), F.max(F.when(F.col("language") == "az", F.col("em_strict"))).alias("a")).where("e is not null and a is not null")
    flagged = wide.join(F.broadcast(largest))
    minus, control = F.col("category") != F.col("_largest"), F.col("category").isin(universal)
    flags = F.array(F.lit("all"), F.when(minus, "minus largest"), F.when(control, "control"), F.when(minus & control, "both"))
    each = flagged.withColumn("subset", F.explode(F.array_compact(flags)))
    by_model = each.groupBy("model", "subset").agg(F.count("*").alias("n"), F.avg(F.col("e") - F.col("a")).alias("gap"))
    return by_model.groupBy("subset").agg(F.sum("n").alias("n"), F.avg("gap").alias("mean_gap"))
