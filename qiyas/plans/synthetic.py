"""Items and runs made from the benchmark table, with known mixtures of right, inflected, misspelt and missing answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qiyas.operators.statistics import hash_uniform

MODELS, LANGUAGES, STYLES = ("m0", "m1", "m2", "m3"), ("az", "en"), ("default", "plain")
PAIRS = (("one", "m0", "m1"), ("two", "m2", "m3"))
#: Share of right answers of the first model, and what each further one and az lose, in percent.
RIGHT, STEP, AZ = 60, 8, 12
PREFIX = {"az": "Sual: Misir. Cavab: ", "en": "Question: Egypt. Answer: "}
LATIN, LOOKALIKE = "aeopcyx", "аеорсух"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        "item_id", words[0].alias("answer"), words[1].alias("answer_en"),
        F.array(F.concat(words[0], F.lit("da")), F.concat(words[0], F.lit("dan"))).alias("answer_aliases"),
        F.array_join(F.slice(words, 3, 10), " ").alias("question_az"), F.array_join(F.slice(words, 4, 10), " ").alias("question_en"),
        (F.col("item_id") % 7).cast("int").alias("category"), (F.col("item_id") % 3).cast("int").alias("provenance"),
    )


def response(u: Column, right: Column, gold: Column, other: Column, question: Column) -> Column:
    return (
        F.when(u < right, gold)
        .when(u < right + 4, F.concat(F.lit('"'), gold, F.lit('"')))
        .when(u < right + 8, F.concat(gold, F.lit("lar")))
        .when(u < right + 12, F.concat(F.lit("Cavab: "), gold, F.lit(".")))
        .when(u < right + 16, F.translate(F.lower(gold), LATIN, LOOKALIKE))
        .when(u < right + 18, question)
        .when(u < right + 20, F.lit(""))
        .when(u < right + 23, F.concat(F.lit("the answer could be "), gold, F.lit(" or not")))
        .otherwise(other)
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each model, language, style and item."""
    it = items(spark, sf_dir)
    n = it.agg(F.count("*").alias("n"))
    nxt = it.select(F.col("item_id").alias("_k"), F.col("answer").alias("_az"), F.col("answer_en").alias("_en"))
    both = it.join(F.broadcast(n)).withColumn("_k", (F.col("item_id") + 1) % F.col("n")).join(nxt, "_k")
    cell = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    cells = both.select("*", cell("model", MODELS)).select("*", cell("language", LANGUAGES)).select("*", cell("prompt_style", STYLES))
    az = F.col("language") == "az"
    gold, other = F.when(az, F.col("answer")).otherwise(F.col("answer_en")), F.when(az, F.col("_az")).otherwise(F.col("_en"))
    question = F.when(az, F.col("question_az")).otherwise(F.col("question_en"))
    right = F.lit(RIGHT) - STEP * F.substring("model", 2, 1).cast("int") - F.when(az, AZ).otherwise(0)
    u = (hash_uniform("item_id", "model", "language", "prompt_style") % 100).cast("int")
    golds = F.when(az, F.concat(F.array("answer"), "answer_aliases")).otherwise(F.array("answer_en"))
    return cells.select(
        "model", "language", "prompt_style", "item_id", "category", "provenance", question.alias("question"), gold.alias("gold"), golds.alias("golds"),
        F.when(az, PREFIX["az"]).otherwise(PREFIX["en"]).alias("prefix"), response(u, right, gold, other, question).alias("raw_response"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, item_id, letter and key out of events: of each type and user the letter of the last event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = e.groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("item_id")).agg(F.max("event_id").alias("_e"))
    letter = lambda c: F.substring(F.lit("ABCD"), (c % 4 + 1).cast("int"), F.lit(1))
    return last.select("model", "item_id", letter(F.col("_e")).alias("letter"), letter(F.col("item_id")).alias("key"))


#: Declared pairs of a study (label, base, tuned, script, target, name of the base) and the percentage of right answers by model and
#: language: az falls alone, both rise but en more, both fall but en more, en falls alone, or both alike.
STUDY_PAIRS = (
    ("a", "m0", "m1", "kiril", "qazax", "org/Qwen3-4B"), ("b", "m0", "m2", "latın", "türk", "org/gemma-3"), ("c", "m0", "m3", "kiril", "rus", "org/Llama-3"),
    ("d", "m1", "m3", "latın", "macar", "lab/Mistral-7B"), ("e", "m1", "m2", "latın", "bask", "lab/Other"), ("f", "m2", "m1", "kiril", "qazax", "qwen/Phi-4"),
    ("g", "m3", "m1", "kiril", "rus", "lab/qwen-2"), ("h", "m2", "m3", "latın", "fransız", "org/Falcon-1"),
)
SHARES = {("m0", "az"): 60, ("m0", "en"): 60, ("m1", "az"): 25, ("m1", "en"): 58, ("m2", "az"): 65, ("m2", "en"): 98, ("m3", "az"): 50, ("m3", "en"): 15}
