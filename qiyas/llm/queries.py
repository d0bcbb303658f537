"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch, so that a batch of long texts fits beside others in an executor.
BATCH_ROWS = "1000"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import packing

    return packing.packed(documents(spark, sf_dir))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import jaccard_join

    return jaccard_join.joined(documents(spark, sf_dir))


OP1_SQL = """
with recursive split as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words
  from documents),
grams as (
  select distinct doc_id, array_to_string(words[i:i + 4], ' ') as g
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) as i from split)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
meets as (select a.doc_id as a, b.doc_id as b, count(*) as met from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select m.a, m.b from meets m join sizes x on x.doc_id = m.a join sizes y on y.doc_id = m.b where 100 * met >= 75 * (x.n + y.n - met)),
reach as (select doc_id, doc_id as other from split union select r.doc_id, l.b from reach r join links l on r.other = l.a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, c.component_id
from split d left join sizes s using (doc_id) join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)
"""


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import fingerprints

    return fingerprints.fingerprinted(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import line_dedup

    kept = line_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = """
with docs as (select doc_id, string_split(text, chr(10)) as parts from documents),
lines as (select doc_id, unnest(parts) as line, unnest(range(0, len(parts))) as k from docs),
formed as (select *, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) as f, row_number() over (order by doc_id, k) as rn from lines),
forms as (select f, min(rn) as rn from formed where f <> '' group by f),
variants as (
  select f, rn, i, hash(left(f, i::int - 1) || substr(f, i::int + 1)) as v
  from (select *, unnest(range(1, length(f) + 1)) as i from forms where length(f) >= 20)),
replaced as (select v, i, length(f) as n, min(rn) as rn from variants group by all having count(*) > 1),
near as (
  select a.rn from variants a join replaced b on a.v = b.v and a.i = b.i and length(a.f) = b.n where a.rn > b.rn
  union
  select greatest(a.rn, b.rn) from variants a join forms b on a.v = hash(b.f) and length(a.f) = length(b.f) + 1 and length(b.f) >= 20),
judged as (
  select l.*, f <> '' and (l.rn > first_value(l.rn) over (partition by f order by l.rn) or n.rn is not null) as gone
  from formed l left join near n on l.rn = n.rn)
select d.doc_id, coalesce(count(j.k), 0) as n_lines, coalesce(count(*) filter (j.gone), 0) as n_removed,
  sha256(case when d.parts is null then null else coalesce(string_agg(j.line, chr(10) order by j.k) filter (not j.gone), '') end) as kept_sha256
from docs d left join judged j using (doc_id) group by d.doc_id, d.parts
"""


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import pieces

    ids = pieces.encoded(documents(spark, sf_dir)).withColumn("n_ids", F.length("ids") / 4).withColumn("ids_crc32", F.crc32("ids"))
    back = pieces.decoded(ids)
    return back.select("doc_id", "n_chunks", F.col("n_ids").cast("long").alias("n_ids"), "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("decoded", 256).eqNullSafe(F.col("text_sha256")).alias("round_trip"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import quality
    from qiyas.llm.language_id import held_out

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0)).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fitted(docs, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import language_id as lid

    docs = documents(spark, sf_dir)
    known = lid.learn(docs.where(~lid.held_out(3, 1)))
    return lid.predict(docs, known).select("doc_id", lid.held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import media

    return media.stored_and_read(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import secrets

    return secrets.report(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import suffix_dedup

    kept = suffix_dedup.deduplicated(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import periodic

    found = periodic.detected(documents(spark, sf_dir), periodic.planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return rows.withColumn("exponent_milli", F.call_function("div", 1000 * F.col("length"), F.col("period")))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import mixing

    taken, quota = mixing.mixed(documents(spark, sf_dir), F.array("source"))
    of = taken.select("doc_id", "size", "taken", F.col("sources")[0].alias("source"))
    return of.join(quota, "source").select("doc_id", "size", "source_size", "target", "taken")


#: A document has one source here, so a source's words are its own and the flow is the smaller of its quota and twice its words.
OP12_SQL = """
with docs as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::bigint as size,
    ('0x' || left(md5(concat_ws('|', '7', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))), 15))::bigint as place
  from documents),
sized as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) as number from docs group by source),
weighed as (select *, [3, 1, 2][(number - 1) % 3 + 1] as weight, 2 * source_size as most from sized),
ordered as (
  select *, sum(most) over w - most as held, sum(weight) over () - (sum(weight) over w - weight) as weighs, sum(source_size) over () as total, row_number() over w as j
  from weighed window w as (order by most / weight, number rows unbounded preceding)),
level as (select held, weighs from ordered where most >= weight * (1.5::double * total - held) / weighs order by j limit 1),
quotas as (select o.source, o.source_size, least(o.most::double, o.weight * (1.5::double * o.total - l.held) / l.weighs) as target from ordered o, level l),
given as (select *, least(round(target)::bigint, 2 * source_size) as given from quotas),
placed as (
  select d.*, q.source_size, q.target, case when q.source_size > 0 then q.given // q.source_size else 0 end as times, case when q.source_size > 0 then q.given % q.source_size else 0 end as rest,
    sum(size) over (partition by d.source order by place range unbounded preceding) as upto, sum(size) over (partition by d.source, place) as block
  from docs d join given q on d.source is not distinct from q.source)
select doc_id, size, source_size, target,
  (size * times + case when upto <= rest then size when upto - block < rest then size * (rest - upto + block) // block else 0 end)::bigint as taken
from placed
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qiyas.llm import divergence

    return divergence.audited(documents(spark, sf_dir))


OP13_SQL = """
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
terms as (select r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as c from terms group by all having count(distinct r) >= 3),
langs as (select lang, count(*) as v, sum(c) as n from kept group by lang),
cells as (select lang, source, term, count(*) as c from terms semi join kept using (lang, term) group by all),
groups as (
  select g.lang, g.source, coalesce(l.v, 0) as v, coalesce(c.n, 0) as n
  from (select distinct lang, source from docs) g left join langs l using (lang) left join (select lang, source, sum(c) as n from cells group by all) c using (lang, source)),
shares as (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c, (1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (g.n + g.v)) as p,
    (1 + (1000000000::hugeint * (k.c + 1)) // (l.n + l.v)) as q
  from groups g join kept k using (lang) join langs l using (lang) left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
apart as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from shares where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from apart)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_fingerprints": op2_fingerprints,
    "op3_line_dedup": op3_line_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_media": op8_media,
    "op9_secrets": op9_secrets,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_mixing": op12_mixing,
    "op13_divergence": op13_divergence,
}
ORACLES: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op3_line_dedup": OP3_SQL, "op12_mixing": OP12_SQL, "op13_divergence": OP13_SQL}
