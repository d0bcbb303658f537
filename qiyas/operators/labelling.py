"""Sheets for people who label rows, and what their labels say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qiyas.functions import text
from qiyas.functions.answers import strip
from qiyas.operators.sampling import error_sample
from qiyas.operators.statistics import cohen_kappa, interpret_kappa

# fixed values: labels of a second reader, the first of which accepts a row; labels of errors; marks in notes; templates of facts known everywhere
AGREEMENT = ("düzgün", "səhv", "qeyri-səlis")
ERRORS = ("faktual", "format", "başqa dil", "mənasız", "qızıl səhv")
WRONG_LANGUAGE, GOLD_ERROR, RELABELLED = "başqa dil", "qızıl səhv", "yenidən etiketləndi"
UNIVERSAL = ("country_capital", "country_currency", "country_official_language")
TURKISH = "abcçdefgğhıijklmnoöprsştuüvyz"
# end of fixed values


def agreement_sheet(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of a sample, with empty cells for a label and a comment."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return items.join(chosen.select("id").distinct(), "id", "left_semi").select("id", *map(blank, ("question_az", "answer", "answer_en", "category")), F.lit("").alias("label"), F.lit("").alias("comment"))


def labelled(answers: DataFrame, items: DataFrame) -> DataFrame:
    """id, label, comment and provenance of the answers whose label is known; items that are gone have ``?`` as their provenance."""
    known = answers.where(F.col("label").isin(*AGREEMENT)).select("id", "label", F.trim(F.coalesce("comment", F.lit(""))).alias("comment"))
    return known.join(items.select("id", "provenance"), "id", "left").withColumn("provenance", F.coalesce("provenance", F.lit("?")))


def agreement_labels(rows: DataFrame) -> DataFrame:
    """n and share of every label, also of those that no row has."""
    total = rows.agg(F.count("*").alias("_t"), *[F.count_if(F.col("label") == x).alias(f"_{k}") for k, x in enumerate(AGREEMENT)]).where("_t > 0")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"_{k}").alias("n")) for k, x in enumerate(AGREEMENT)]))
    return total.select("_t", each.alias("x")).select("x.label", "x.n", (F.col("x.n") / F.col("_t")).alias("share"))


def agreement_summary(rows: DataFrame, group: str | None = None) -> DataFrame:
    """n, agreement, kappa and its reading against a first reader who accepted every row; in all or by group."""
    by = [group] if group else ["_all"]
    out = cohen_kappa(rows.withColumns({"_all": F.lit(1), "_first": F.lit(AGREEMENT[0])}), by, "_first", "label")
    return out.withColumn("reading", interpret_kappa(F.col("kappa"))).drop("_all")


def agreement_confusion(rows: DataFrame) -> DataFrame:
    """n of each pair of the first reader's label and the second's."""
    return rows.groupBy(F.lit(AGREEMENT[0]).alias("first"), F.col("label").alias("second")).agg(F.count("*").alias("n"))


def disagreements(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that the second reader doesn't accept, with their question, answer and comment; nothing is deleted for that."""
    return rows.where(F.col("label") != AGREEMENT[0]).join(items.select("id", "question_az", "answer"), "id", "left").select("id", "label", "question_az", "answer", "comment")


def error_sheet(errors: DataFrame, models: list[str], size: int, seed: int = 0) -> DataFrame:
    """For each model a sample of the errors that no rule accounts for, by category, with empty cells. errors(model, id, question, gold, prediction, category, error_type_auto)."""
    out = None
    for m in models:
        left = errors.where((F.col("model") == m) & (F.trim(F.coalesce("error_type_auto", F.lit(""))) == ""))
        rows = error_sample(left, "category", "id", size, seed).select("model", "id", F.col("question").alias("sual"), F.col("gold").alias("qızıl cavab"), F.col("prediction").alias("modelin cavabı"), F.lit("").alias("etiket"), F.lit("").alias("qeyd"))
        out = rows if out is None else out.unionByName(rows)
    return out


def error_labels(sheet: DataFrame) -> DataFrame:
    """model, label, n and share of a filled sheet: every label for every model that has one. Unknown labels don't count."""
    known = sheet.select("model", strip(F.coalesce("etiket", F.lit(""))).alias("label")).where(F.col("label").isin(*ERRORS))
    wide = known.groupBy("model").agg(F.count("*").alias("_t"), *[F.count_if(F.col("label") == x).alias(f"_{k}") for k, x in enumerate(ERRORS)])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"_{k}").alias("n")) for k, x in enumerate(ERRORS)]))
    return wide.select("model", "_t", each.alias("x")).select("model", "x.label", "x.n", (F.col("x.n") / F.col("_t")).alias("share"))


def error_notes(sheet: DataFrame) -> DataFrame:
    """One row: labelled rows, those labelled anew later, and those whose gold answer is in doubt."""
    label = strip(F.coalesce("etiket", F.lit("")))
    known = sheet.where(label.isin(*ERRORS))
    return known.agg(F.count("*").alias("labelled"), F.count_if(F.coalesce("qeyd", F.lit("")).contains(RELABELLED)).alias("relabelled"), F.count_if(label == GOLD_ERROR).alias("gold_errors"))


def is_subset(alphabet: str = TURKISH, of: str = text.ALPHABET) -> bool:
    return set(alphabet) <= set(of)


def confusion(sheet: DataFrame) -> DataFrame:
    """One row: labelled errors, those in another language, how many of these a test by letters catches, and the share that it misses (null if there are none)."""
    wrong = strip(F.coalesce("etiket", F.lit(""))) == WRONG_LANGUAGE
    caught = F.size(text.out_of_script(F.coalesce("modelin cavabı", F.lit("")))) > 0
    out = sheet.agg(F.count("*").alias("errors"), F.count_if(wrong).alias("wrong"), F.count_if(wrong & caught).alias("caught"))
    return out.withColumn("missed", F.col("wrong") - F.col("caught")).withColumn("share", F.when(F.col("wrong") > 0, F.col("missed") / F.col("wrong")))


def confusion_rows(sheet: DataFrame) -> DataFrame:
    """id, answer and letters of the rows in another language; no letters if the test misses one."""
    letters = F.array_join(text.out_of_script(F.coalesce("modelin cavabı", F.lit(""))), "")
    return sheet.where(strip(F.coalesce("etiket", F.lit(""))) == WRONG_LANGUAGE).select("id", F.col("modelin cavabı").alias("answer"), letters.alias("letters"))


def universal(items: DataFrame) -> DataFrame:
    """item_id of the rows made from templates whose facts are known everywhere; rows without a template don't count."""
    return items.where(F.regexp_extract(F.coalesce("notes", F.lit("")), "template=([a-z_]+)", 1).isin(*UNIVERSAL)).select("item_id")


def group_key(notes, dimension: str):
    """The template or variant that a row's notes name, ``—`` if none."""
    found = F.regexp_extract(F.coalesce(notes, F.lit("")), f"{dimension}=([^;]*)", 1)
    return F.when(F.coalesce(notes, F.lit("")).contains(f"{dimension}="), found).otherwise("—")
