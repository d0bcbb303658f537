"""Scans and sinks of item tables, run logs, label sheets and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qiyas.functions.answers import excel_safe, letter_of
from qiyas.operators import numbering
from qiyas.sources import shared

ITEM_SCHEMA = (
    "id string, question_az string, question_en string, answer string, answer_en string, answer_aliases array<string>, "
    "category string, source string, provenance string, verified_by string, difficulty string, notes string"
)
RUN_SCHEMA = (
    "id string, model string, language string, prompt_style string, prompt string, raw_response string, "
    "generation struct<max_new_tokens: int, do_sample: boolean, temperature: double, seed: int, batch_size: int>, "
    "environment struct<python: string, platform: string>, timestamp string, "
    "backend struct<provider: string, requested_model: string, resolved_model: string, max_tokens: int, base_url: string, "
    "chat_template_requested: boolean, chat_template_applied: boolean, model_revision: string>"
)
MCQ_SCHEMA = "id string, model string, condition string, subject string, max_new_tokens int, raw_response string"


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """file, line (from 1 in its file, blank lines counted) and raw of text files of any size.

    A file is read by many tasks, each of which takes the lines that begin in its split. The lines are written once with their place in their
    task; how many lines the splits before hold is a sum over one row a split.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    at = (F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_split"))
    rows = shared.written(lines.select(*at, F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw")), "lines")
    splits = rows.groupBy("_path", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_split")) - F.col("_n")
    return rows.join(splits.withColumn("_before", before), ["_path", "_split"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), "raw")


def read_jsonl(spark: SparkSession, path: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """Rows of JSON lines with file, line and error; malformed lines, as a torn last one, stay with error set, blank ones don't."""
    rows = numbered_lines(spark, path, pattern).where(F.trim("raw") != "")
    parsed = rows.withColumn("_r", F.from_json("raw", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.select("file", "line", "_r.*", F.col("_r._bad").alias("error")).drop("_bad")


def unknown_fields(rows: DataFrame, raw: str, schema: str) -> DataFrame:
    """Adds unknown: the keys of a JSON object that the schema lacks."""
    keys = F.map_keys(F.from_json(raw, "map<string,string>"))
    return rows.withColumn("unknown", F.array_except(keys, F.array(*[F.lit(f.name) for f in T.StructType.fromDDL(schema).fields])))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run logs with defaults for language, style and model (the file's stem); of equal ids of a run the last line of the last file counts."""
    raw = spark.read.schema(RUN_SCHEMA).option("pathGlobFilter", "*.jsonl").json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", "")
    rows = raw.select("*", F.coalesce("model", stem).alias("_m"), F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_at"))
    rows = rows.withColumns({"model": F.col("_m"), "language": F.coalesce("language", F.lit("az")), "prompt_style": F.coalesce("prompt_style", F.lit("default"))}).drop("_m")
    key = ["model", "language", "prompt_style", "id"]
    value = [c for c in rows.columns if c not in (*key, "_at")]
    last = rows.where(F.col("id").isNotNull()).groupBy(*key).agg(F.max_by(F.struct(*value), "_at").alias("v"))
    return last.select(*key, "v.*")


def provenance(runs: DataFrame) -> DataFrame:
    """How each run was obtained: by an API exactly if its backend names a provider."""
    api = F.col("backend.provider").isNotNull()
    return runs.groupBy("model", "language", "prompt_style").agg(F.count("*").alias("n"), F.bool_or(api).alias("api"), F.max("backend.resolved_model").alias("resolved_model"), F.max("generation.max_new_tokens").alias("max_new_tokens")).withColumn("source", F.when(F.col("api"), "api").otherwise("local"))


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """model, id and letter of multiple-choice logs; responses without a letter are left out."""
    rows = spark.read.schema(MCQ_SCHEMA).option("pathGlobFilter", "*__mcq.jsonl").json(path)
    return rows.select("model", "id", letter_of(F.col("raw_response")).alias("letter")).where("letter <> ''")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet with a header, whose first name may carry a byte order mark; cells are trimmed."""
    rows = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    return rows.select(*[F.trim(F.col(f"`{c}`")).alias(c.lstrip("﻿").strip()) for c in rows.columns])


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def write_sheet(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV whose text cells can't be taken for formulas; with ``mark`` each file begins with a byte order mark, so that spreadsheets take it for UTF-8."""
    cells = [excel_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields]
    out = df.select(*cells)
    if mark:
        out = out.toDF("\ufeff" + out.columns[0], *out.columns[1:])
    # the tab before a cell must stay
    out.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").mode("errorifexists").csv(path)


def run_file_name(model: str, language: str, style: str = "default") -> str:
    stem = f"{model.replace('/', '__').replace(':', '_')}__{language}"
    return f"{stem}.jsonl" if style == "default" else f"{stem}__{style}.jsonl"


def next_free_id(items: DataFrame) -> DataFrame:
    """One row: the number after the largest of ids az-NNN."""
    return items.agg((F.coalesce(F.max(F.regexp_extract("id", r"^az-(\d+)$", 1).try_cast("int")), F.lit(0)) + 1).alias("next_id"))


def numbered(items: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """Adds id az-NNN in the order of columns, without one task for all rows."""
    return numbering.numbered(items, order, "_number", start).withColumn("id", F.format_string("az-%03d", "_number")).drop("_number")


def built(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Human-verified rows, or none while any row has an error."""
    errors = issues.where("severity = 'error'").agg(F.count("*").alias("_errors"))
    return items.join(F.broadcast(errors)).where((F.col("_errors") == 0) & (F.col("verified_by") == "human")).drop("_errors", "difficulty")
