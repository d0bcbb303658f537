"""Measurement gates: runs whose responses can't be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qiyas.functions import answers
from qiyas.operators.scoring import RUN

# fixed values: shares above which a run fails, and gaps below which a score is at the floor
EMPTY, ECHO, RECOVERABLE, FLOOR, NEAR_FLOOR = 0.20, 0.20, 0.30, 0.05, 0.10
# end of fixed values


def rates(scores: DataFrame) -> DataFrame:
    """Shares of empty, example-echoing and question-echoing responses and of recoverable wrong ones, in one aggregate.

    scores: output of ``scored`` with question, gold and prefix (the prompt's part before the question).
    """
    raw, wrong = F.col("raw_response"), F.col("em_strict") == 0
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return scores.groupBy(*RUN).agg(
        F.count("*").alias("n"),
        share(answers.strip(F.coalesce(raw, F.lit(""))) == "").alias("empty_rate"),
        share(answers.echoes_examples(raw, F.col("prefix"))).alias("example_echo_rate"),
        F.coalesce(F.avg(F.when(F.col("question").isNotNull(), answers.echoes_question(raw, F.col("question")).cast("double"))), F.lit(0.0)).alias("question_echo_rate"),
        F.sum(wrong.cast("int")).alias("wrong"),
        F.coalesce(F.avg(F.when(wrong, answers.answer_present(raw, F.col("gold")).cast("double"))), F.lit(0.0)).alias("recoverable_rate"),
    )


def gated(rate: DataFrame) -> DataFrame:
    """Adds the first gate that a run fails, null if none."""
    first = F.coalesce(
        F.when(F.col("empty_rate") > EMPTY, "empty"), F.when(F.col("example_echo_rate") > ECHO, "example echo"),
        F.when(F.col("question_echo_rate") > ECHO, "question echo"), F.when(F.col("recoverable_rate") > RECOVERABLE, "extraction"),
    )
    return rate.withColumn("failed_gate", first)


def funnel(rate: DataFrame, covered: DataFrame) -> DataFrame:
    """Runs left after each gate in turn; covered: runs with complete."""
    both = rate.join(covered.select(*RUN, "complete"), RUN, "left")
    tests = [F.coalesce("complete", F.lit(False)), F.col("empty_rate") <= EMPTY, F.col("example_echo_rate") <= ECHO, F.col("question_echo_rate") <= ECHO, F.col("recoverable_rate") <= RECOVERABLE]
    names, passed, sums = ["covered", "not_empty", "no_example_echo", "no_question_echo", "extractable"], F.lit(True), [F.count("*").alias("runs")]
    for name, test in zip(names, tests, strict=True):
        passed = passed & test
        sums.append(F.sum(passed.cast("int")).alias(name))
    return both.agg(*sums)


def floor_mark(em: Column) -> Column:
    """``*`` below the floor, ``+`` near it."""
    return F.when(em < FLOOR, "*").when(em < NEAR_FLOOR, "+").otherwise("")

