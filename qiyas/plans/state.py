"""Queries of streams, logs and prompts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qiyas.functions import prompts
from qiyas.plans import oracle, synthetic
from qiyas.plans.catalogue import Query, table
from qiyas.sources import logs, shared
from qiyas.streaming import failures, snapshots

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _files_in_order(rows: DataFrame, key: str, order: str, base: str, parts: int = 3) -> str:
    """Rows as files of a log that grew in ``parts`` steps: a key's rows of a step lie in one file."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = F.least(F.lit(parts - 1), F.floor((F.col(order) - F.lit(low or 0)) * parts / F.lit((high or 0) - (low or 0) + 1)))
    for k in range(parts):
        rows.where(step == k).repartition(key).write.mode("append").parquet(f"{base}/in")
    return f"{base}/in"


#: Calls that fail, and how many of them in a row end a user's run.
FAILING, LIMIT = ("error", "view"), 5


@query
def failure_streaks(spark, sf_dir):
    """Each user's events as calls, in the order of event_id, as a stream of several batches."""
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").isin(*FAILING).alias("failed"))
    base = shared.new_path(spark, "streaks")
    path = _files_in_order(calls, "user_id", "event_id", base)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 256).parquet(path)
    found = failures.streaks(stream, "user_id", "event_id", "failed", LIMIT)
    write = lambda batch, _: batch.write.mode("append").parquet(f"{base}/log")
    found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return failures.latest(spark.read.parquet(f"{base}/log"), "user_id")


ORACLES["failure_streaks"] = f"""with c as (select user_id, event_id, event_type in {FAILING} as failed, row_number() over (partition by user_id order by event_id) as rn from events),
s as (select *, case when failed then rn - coalesce(max(rn) filter (not failed) over (partition by user_id order by event_id), 0) else 0 end as run from c),
t as (select *, min(event_id) filter (run >= {LIMIT}) over (partition by user_id) as stopped from s)
select user_id, count(*) as calls, count(*) filter (failed) as failures, arg_max(run, event_id)::bigint as streak, max(run)::bigint as longest, any_value(stopped) as stopped
from t where stopped is null or event_id <= stopped group by user_id"""


def _label():
    return F.concat_ws(" ", "event_type", F.col("amount").cast("string"))


@query
def review_upserts(spark, sf_dir):
    """Events as edits of one row a user, merged batch by batch; users whose rows are equal but for the key are duplicates."""
    edits = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor("value").cast("long").alias("amount"))
    base = shared.new_path(spark, "reviews")
    path = _files_in_order(edits, "user_id", "event_id", base)
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 256).parquet(path)
    snapshots.run(stream, "user_id", "event_id", _label, f"{base}/table", f"{base}/state").awaitTermination()
    return snapshots.Snapshots(spark, f"{base}/table").read().drop("checked")


ORACLES["review_upserts"] = """with e as (select user_id, max(event_id) as event_id from events group by user_id),
r as (select user_id, event_id, event_type, floor(value)::bigint as amount from e join events using (user_id, event_id))
select user_id, event_id, event_type, amount, min(user_id) over (partition by event_type, amount) as first from r"""


@query
def jsonl_lines(spark, sf_dir):
    """Documents as JSON lines that say which line of their file they are, some followed by a blank line, some torn; read back and numbered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = F.explode(F.when(F.col("doc_id") % 50 == 0, F.array(F.lit("whole"), F.lit("blank"))).when(F.col("doc_id") % 97 == 0, F.array(F.lit("torn"))).otherwise(F.array(F.lit("whole"))))
    lines = docs.select("doc_id", "text", kinds.alias("kind")).withColumn("k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1)
    whole = F.to_json(F.struct("k", "doc_id", "text"))
    value = F.when(F.col("kind") == "blank", "").when(F.col("kind") == "torn", F.substring(whole, F.lit(1), (F.length(whole) / 2).cast("int"))).otherwise(whole)
    base = shared.new_path(spark, "jsonl")
    lines.select(value.alias("value")).write.text(f"{base}/in")
    back = logs.read_jsonl(spark, f"{base}/in", "k long, doc_id long, text string", "*.txt")
    bad = F.col("error").isNotNull()
    return back.select(F.when(~bad, F.col("doc_id")).alias("doc_id"), F.when(~bad, F.md5("text")).alias("text_md5"), F.when(~bad, F.col("line") - F.col("k")).alias("off"), bad.alias("bad"))


ORACLES["jsonl_lines"] = """select case when not torn then doc_id end as doc_id, case when not torn then md5(text) end as text_md5, case when not torn then 0::bigint end as off, torn as bad
from (select *, doc_id % 97 = 0 and doc_id % 50 <> 0 as torn from documents)"""


@query
def prompts_by_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's prompt in each style and language, and its prompt of a choice; some questions hold the fields' own names."""
    items = synthetic.items(spark, sf_dir)
    odd = F.when(F.col("item_id") % 3 == 0, " {options} {question}").otherwise("")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("prompt_style"), F.lit(g).alias("language"), F.col(f"question_{g}").alias("question")) for s, of in prompts.STYLES.items() for g in of]))
    asked = items.select("item_id", each.alias("x")).select("item_id", "x.prompt_style", "x.language", F.concat("x.question", odd).alias("question"))
    written = prompts.prompted(asked, prompts.style_table(spark)).select("item_id", "prompt_style", "language", "prompt")
    choices = F.array("answer", "answer_en", F.lit("{question}"), F.lit("y"), F.lit("left out"))
    choice = prompts.build_choice_prompt(F.lit(prompts.CHOICE), F.concat("question_az", odd), choices)
    return written.unionByName(items.select("item_id", F.lit("choice").alias("prompt_style"), F.lit("az").alias("language"), choice.alias("prompt")))


def _pieces(template: str, values: dict[str, str]) -> str:
    """SQL of a template whose fields are SQL values: literals between them, joined."""
    for field in values:
        template = template.replace(field, f"\x00{field}\x00")
    part = lambda p: values.get(p) or "'" + p.replace("'", "''") + "'"
    return " || ".join(part(p) for p in template.split("\x00") if p)


_ODD = "case when item_id % 3 = 0 then ' {options} {question}' else '' end"
ORACLES["prompts_by_style"] = f"with {oracle.ITEMS}\n" + "\nunion all ".join(
    [f"select item_id, '{s}' as prompt_style, '{g}' as language, {_pieces(t, {'{question}': f'question_{g} || {_ODD}'})} as prompt from items" for s, of in prompts.STYLES.items() for g, t in of.items()]
    + [f"select item_id, 'choice', 'az', {_pieces(prompts.CHOICE, {'{question}': f'question_az || {_ODD}', '{options}': '''(\'A) \' || answer || chr(10) || \'B) \' || answer_en || chr(10) || \'C) {question}\' || chr(10) || \'D) y\')'''})} from items"]
)
