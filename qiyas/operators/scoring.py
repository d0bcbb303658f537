"""Scores of answers against golds, and tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qiyas.functions import answers, text
from qiyas.functions.text import MODES, STRICT, Mode
from qiyas.operators.statistics import bootstrap_hash, bootstrap_hashes, compared

RUN = ["model", "language", "prompt_style"]
COVERAGE = 0.90


def exact_match(prediction: Column, gold: Column, mode: Mode = STRICT) -> Column:
    return (text.normalize(prediction, mode) == text.normalize(gold, mode)).cast("double")


def token_f1(prediction: Column, gold: Column, mode: Mode = STRICT) -> Column:
    return text.token_f1(text.tokens(prediction, mode), text.tokens(gold, mode))


def best_em(prediction: Column, golds: Column, mode: Mode) -> Column:
    p = text.normalize(prediction, mode)
    return F.array_max(F.transform(golds, lambda g: (p == text.normalize(g, mode)).cast("double")))


def best_f1(prediction: Column, golds: Column, mode: Mode) -> Column:
    p = text.tokens(prediction, mode)
    return F.array_max(F.transform(golds, lambda g: text.token_f1(p, text.tokens(g, mode))))


def gold_answers(language: Column, answer: Column, aliases: Column, answer_en: Column) -> Column:
    """Azerbaijani: the answer and its aliases. English: the answer, and its words if it has more than the other."""
    count = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    words = F.filter(F.split(answer_en, r"(?U)\s+"), lambda w: w != "")
    more = F.when(count(answer_en) > F.greatest(count(answer), F.lit(1)), words).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.when(language == "az", F.concat(F.array(answer), F.coalesce(aliases, none))).otherwise(F.concat(F.array(answer_en), more))


def scored(runs: DataFrame) -> DataFrame:
    """Adds prediction, and em_<mode> and f1_<mode> for every mode, in one projection without a shuffle."""
    base = runs.withColumn("prediction", answers.extract_answer(F.col("raw_response")))
    out = {}
    for m in MODES:
        out[f"em_{m.name}"] = best_em(F.col("prediction"), F.col("golds"), m)
        out[f"f1_{m.name}"] = best_f1(F.col("prediction"), F.col("golds"), m)
    return base.withColumns(out)


def score_table(scores: DataFrame) -> DataFrame:
    """One row for each run, item and mode."""
    each = F.explode(F.array(*[F.struct(F.lit(m.name).alias("mode"), F.lit(i).alias("mode_order"), F.col(f"em_{m.name}").alias("em"), F.col(f"f1_{m.name}").alias("f1")) for i, m in enumerate(MODES)]))
    return scores.select(*RUN, "item_id", each.alias("_s")).select(*RUN, "item_id", "_s.*")


def classify_error(prediction: Column, golds: Column) -> Column:
    """The first rule that accounts for an answer: blank, then the mode that accepts it, script, overlap; else empty.

    The labels are those of hand-labelled sheets, so both can be joined.
    """
    hit = lambda m: best_em(prediction, golds, m) == 1
    return (
        F.when(answers.strip(prediction) == "", "boş cavab")
        .when(hit(text.STRICT), "")
        .when(hit(text.MORPH), "morfologiya")
        .when(hit(text.LENIENT), "diakritika")
        .when(hit(text.TRANSLIT), "yazı sistemi")
        .when(text.has_cyrillic(prediction), "kiril, zəncir bərpa etmir")
        .when(best_f1(prediction, golds, STRICT) > 0, "qismən üst-üstə düşmə")
        .otherwise("")
    )


def main_table(scores: DataFrame, resamples: int = 1000) -> DataFrame:
    """Each run's number of items, strict EM and F1 with bootstrap intervals, and the share of the most frequent gold."""
    out = majority_baseline(scores, RUN).withColumnsRenamed({"majority": "baseline"})
    both = scores.select(*RUN, "item_id", F.col("em_strict").alias("em"), F.col("f1_strict").alias("f1"))
    drawn = bootstrap_hashes(both, RUN, "item_id", ["em", "f1"], resamples).drop("n").withColumnsRenamed({"em_mean": "em", "f1_mean": "f1"})
    return out.join(drawn, RUN)


def error_summary(errors: DataFrame, group: list[str]) -> DataFrame:
    """n and share of each error label within a group."""
    counts = errors.groupBy(*group, "error").agg(F.count("*").alias("n"))
    total = counts.groupBy(*group).agg(F.sum("n").alias("_t"))
    return counts.join(total, group).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def format_contrast(choices: DataFrame, written: DataFrame, resamples: int = 1000) -> DataFrame:
    """Choosing against writing: for each model and mode n, both means, their difference with its interval, and p.

    choices(model, item_id, chosen: 1 if the letter is the key), written(model, item_id, em_<mode>). Items that either lacks don't count.
    """
    both = choices.join(written, ["model", "item_id"])
    each = F.explode(F.array(*[F.struct(F.lit(m.name).alias("mode"), F.col(f"em_{m.name}").alias("wrote")) for m in MODES]))
    return compared(both.select("model", "item_id", "chosen", each.alias("x")).select("model", "item_id", "chosen", "x.*"), ["model", "mode"], "item_id", "chosen", "wrote", resamples)


def retention(choices: DataFrame, written: DataFrame, resamples: int = 1000) -> DataFrame:
    """Of the items whose key a model chose, the share that it also writes, strictly and after the last mode, with its interval."""
    right = choices.where("chosen = 1").join(written, ["model", "item_id"])
    each = F.explode(F.array(*[F.struct(F.lit(m.name).alias("mode"), F.col(f"em_{m.name}").alias("wrote")) for m in (STRICT, MODES[-1])]))
    rows = right.select("model", "item_id", each.alias("x")).select("model", "item_id", "x.*")
    return bootstrap_hash(rows, ["model", "mode"], "item_id", "wrote", resamples).withColumnRenamed("mean", "kept")


def modes_table(scores: DataFrame) -> DataFrame:
    """EM of each run in the four modes and what each step adds."""
    em = {m.name: F.avg(f"em_{m.name}") for m in MODES}
    out = scores.groupBy(*RUN).agg(F.count("*").alias("n"), *[c.alias(f"em_{k}") for k, c in em.items()])
    return out.withColumns({"morph_gain": F.col("em_morph") - F.col("em_strict"), "lenient_gain": F.col("em_lenient") - F.col("em_morph"), "translit_gain": F.col("em_translit") - F.col("em_lenient")})


def majority_baseline(golds: DataFrame, group: list[str]) -> DataFrame:
    """Share of the most frequent normalised first gold."""
    each = golds.groupBy(*group, text.normalize(F.col("gold"), STRICT).alias("_g")).agg(F.count("*").alias("_n"))
    return each.groupBy(*group).agg(F.sum("_n").alias("n"), (F.max("_n") / F.sum("_n")).alias("majority"))


def coverage(runs: DataFrame, items: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """Shared items of each run and whether they reach the threshold; of an empty item table all runs are complete."""
    total = items.agg(F.countDistinct("item_id").alias("total"))  # one row
    counted = runs.join(items.select("item_id").distinct(), "item_id", "left_semi").groupBy(*RUN).agg(F.countDistinct("item_id").alias("shared"))
    found = runs.select(*RUN).distinct().join(counted, RUN, "left").join(F.broadcast(total))
    return found.select(*RUN, F.coalesce("shared", F.lit(0)).alias("shared"), "total", (F.coalesce("shared", F.lit(0)) >= F.col("total") * threshold).alias("complete"))


def pivot_em(scores: DataFrame, rows: list[str], column: str, values: list) -> DataFrame:
    """Mean strict EM with one column for each listed value."""
    return scores.groupBy(*rows).pivot(column, values).agg(F.avg("em_strict"))
