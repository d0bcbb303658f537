"""Prompts of items by style, and the part of a prompt that stands before its question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION, OPTIONS = "{question}", "{options}"
LETTERS = "ABCD"
_FIELD = r"\{question\}|\{options\}"

# fixed values: the prompt styles by language, and the prompt of a choice
STYLES = {
    "default": {
        "az": "Suala qısa cavab ver. Yalnız cavabı yaz — cümlə qurma, izahat vermə.\n\nSual: Misirin paytaxtı hansı şəhərdir?\nCavab: Qahirə\n\nSual: Su molekulunun kimyəvi formulu nədir?\nCavab: H2O\n\nSual: {question}\nCavab:",
        "en": "Answer the question briefly. Write only the answer — no sentence, no explanation.\n\nQuestion: What is the capital city of Egypt?\nAnswer: Cairo\n\nQuestion: What is the chemical formula of a water molecule?\nAnswer: H2O\n\nQuestion: {question}\nAnswer:",
    },
    "script": {
        "az": "Suala qısa cavab ver. Yalnız cavabı yaz — cümlə qurma, izahat vermə.\nCavabı MÜTLƏQ Azərbaycan latın əlifbası ilə yaz.\n\nSual: Misirin paytaxtı hansı şəhərdir?\nCavab: Qahirə\n\nSual: Su molekulunun kimyəvi formulu nədir?\nCavab: H2O\n\nSual: {question}\nCavab:",
        "en": "Answer the question briefly. Write only the answer — no sentence, no explanation.\nWrite the answer using the Latin alphabet.\n\nQuestion: What is the capital city of Egypt?\nAnswer: Cairo\n\nQuestion: What is the chemical formula of a water molecule?\nAnswer: H2O\n\nQuestion: {question}\nAnswer:",
    },
    "zeroshot": {
        "az": "Aşağıdakı suala qısa cavab ver. Yalnız cavabı yaz.\n\nSual: {question}\nCavab:",
        "en": "Answer the following question briefly. Write only the answer.\n\nQuestion: {question}\nAnswer:",
    },
    "plain": {
        "az": "Suala qısa cavab ver. Yalnız cavabı yaz.\n\nMisirin paytaxtı hansı şəhərdir?\nQahirə\n\nSu molekulunun kimyəvi formulu nədir?\nH2O\n\n{question}\n",
        "en": "Answer the question briefly. Write only the answer.\n\nWhat is the capital city of Egypt?\nCairo\n\nWhat is the chemical formula of a water molecule?\nH2O\n\n{question}\n",
    },
    "oneshot": {
        "az": "Suala qısa cavab ver. Yalnız cavabı yaz — cümlə qurma, izahat vermə.\n\nSual: Misirin paytaxtı hansı şəhərdir?\nCavab: Qahirə\n\nSual: {question}\nCavab:",
        "en": "Answer the question briefly. Write only the answer — no sentence, no explanation.\n\nQuestion: What is the capital city of Egypt?\nAnswer: Cairo\n\nQuestion: {question}\nAnswer:",
    },
}
CHOICE = "Suala cavab ver. Yalnız düzgün variantın hərfini yaz.\n\nSual: Misirin paytaxtı hansı şəhərdir?\nA) İsgəndəriyyə\nB) Qahirə\nC) Luksor\nD) Aswan\nCavab: B\n\nSual: Su molekulunun kimyəvi formulu nədir?\nA) CO2\nB) NaCl\nC) H2O\nD) O2\nCavab: C\n\nSual: {question}\n{options}\nCavab:"
# end of fixed values


def segments(template: Column) -> Column:
    """The template cut before and behind each field, so that fields are parts of their own."""
    return F.split(template, rf"(?<=({_FIELD}))|(?=({_FIELD}))")


def filled(template: Column, question: Column, options: Column | None = None) -> Column:
    """The template with its fields replaced in one pass: fields within a question or an option stay as they are. Null if a value is."""
    other = F.lit(OPTIONS) if options is None else options
    parts = F.transform(segments(template), lambda p: F.when(p == QUESTION, question).when(p == OPTIONS, other).otherwise(p))
    missing = question.isNull() | other.isNull()
    return F.when(~missing, F.array_join(parts, ""))


def prompt_prefix(template: Column) -> Column:
    """What a template holds before its question: instructions and examples."""
    return F.substring_index(template, QUESTION, 1)


def build_prompt(template: Column, question: Column) -> Column:
    """The template with the question in its place; null if either is."""
    return filled(template, question)


def listed_options(choices: Column) -> Column:
    """A line for each choice, behind its letter; choices beyond the letters are left out."""
    place = lambda c, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(") "), c)
    return F.array_join(F.transform(F.slice(choices, 1, len(LETTERS)), place), "\n")


def build_choice_prompt(template: Column, question: Column, choices: Column) -> Column:
    """A template of a question and its options."""
    return filled(template, question, listed_options(choices))


def style_table(spark: SparkSession) -> DataFrame:
    """prompt_style, language and template of the styles above."""
    rows = [(style, language, template) for style, of in STYLES.items() for language, template in of.items()]
    return spark.createDataFrame(rows, "prompt_style string, language string, template string")


def prompted(items: DataFrame, styles: DataFrame) -> DataFrame:
    """Adds prompt to rows with prompt_style, language and question; fails on a style or language that the table lacks. styles is a small stated table."""
    found = items.join(F.broadcast(styles), ["prompt_style", "language"], "left")
    unknown = F.raise_error(F.concat(F.lit("unknown prompt style or language: "), F.concat_ws(", ", "prompt_style", "language")))
    prompt = F.when(F.col("template").isNull(), unknown.cast("string")).otherwise(filled(F.col("template"), F.col("question")))
    return found.withColumn("prompt", prompt).drop("template")
