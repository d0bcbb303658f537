"""The registered queries: each applies operators of the library to the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qiyas.functions import answers, morphology, prompts, text
from qiyas.functions.text import MODES, STRICT
from qiyas.operators import curation, gates, paired, sampling, scoring, statistics
from qiyas.operators.scoring import RUN
from qiyas.plans import oracle, synthetic
from qiyas.sources import shared
from qiyas.streaming import append_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) + 0.0 for c in columns})  # no negative zeros


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(synthetic.runs(spark, sf_dir))


def _norm(mode: text.Mode) -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text"), mode)).alias("norm_md5"))


for _m in MODES:
    QUERIES[f"norm_{_m.name}"] = _norm(_m)


@query
def token_f1_docs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    n = b.agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").join(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n"))
    both = docs.select("doc_id", "item_id", "text").join(b.select("item_id", F.col("text").alias("gold")), "item_id")
    return both.select("doc_id", F.round(scoring.token_f1(F.col("text"), F.col("gold")), 9).alias("f1"))


@query
def mode_decomposition(spark, sf_dir):
    return rounded(scoring.modes_table(_scores(spark, sf_dir)), "em_strict", "em_morph", "em_lenient", "em_translit", "morph_gain", "lenient_gain", "translit_gain")


@query
def score_best_gold(spark, sf_dir):
    return rounded(_scores(spark, sf_dir).select(*RUN, "item_id", "em_strict", "em_morph", "em_lenient", "em_translit", "f1_strict", "f1_translit"), "f1_strict", "f1_translit")


@query
def extract_answer_runs(spark, sf_dir):
    return synthetic.runs(spark, sf_dir).select(*RUN, "item_id", answers.extract_answer(F.col("raw_response")).alias("prediction"))


@query
def classify_errors(spark, sf_dir):
    rows = synthetic.runs(spark, sf_dir).select(*RUN, scoring.classify_error(answers.extract_answer(F.col("raw_response")), F.col("golds")).alias("error"))
    return rows.groupBy(*RUN, "error").agg(F.count("*").alias("n"))


@query
def script_share(spark, sf_dir):
    p = answers.extract_answer(F.col("raw_response"))
    return synthetic.runs(spark, sf_dir).groupBy(*RUN).agg(F.count("*").alias("n"), F.count_if(text.has_cyrillic(p)).alias("cyrillic"))


@query
def out_of_script_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.out_of_script(F.col("text")), "").alias("letters"))


@query
def mcq_suspects(spark, sf_dir):
    return curation.suspects(synthetic.votes(spark, sf_dir))


@query
def chance_agreement(spark, sf_dir):
    n = synthetic.votes(spark, sf_dir).agg(F.count_distinct("model").alias("models"), F.count_distinct("item_id").alias("items"))
    return n.withColumn("expected", F.round(statistics.chance_agreement(F.col("models"), F.col("items")), 9))


@query
def majority_baseline(spark, sf_dir):
    golds = synthetic.items(spark, sf_dir).select(F.explode(F.array(F.struct(F.lit("az").alias("language"), F.col("answer").alias("gold")), F.struct(F.lit("en").alias("language"), F.col("answer_en").alias("gold")))).alias("x")).select("x.*")
    return rounded(scoring.majority_baseline(golds, ["language"]), "majority")


@query
def dataset_stats(spark, sf_dir):
    words = F.size(F.filter(F.split("text", "[ \\n]+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_distinct("text").alias("distinct_texts"), F.count_distinct("source").alias("sources"),
        F.round(F.avg(words), 9).alias("mean_words"), F.max(words).cast("long").alias("max_words"),
    )


def _pivot(spark, sf_dir, column: str, values: int, letter: str) -> DataFrame:
    out = scoring.pivot_em(_scores(spark, sf_dir), ["model", "language"], column, list(range(values)))
    return out.select("model", "language", *[F.round(F.col(str(k)), 9).alias(f"{letter}{k}") for k in range(values)])


@query
def breakdown_pivot(spark, sf_dir):
    return _pivot(spark, sf_dir, "category", 7, "c")


@query
def provenance_pivot(spark, sf_dir):
    return _pivot(spark, sf_dir, "provenance", 3, "p")


def _partial_runs(spark, sf_dir) -> DataFrame:
    return synthetic.runs(spark, sf_dir).where("not (model = 'm3' and item_id % 8 = 0)")


@query
def coverage_partition(spark, sf_dir):
    return scoring.coverage(_partial_runs(spark, sf_dir), synthetic.items(spark, sf_dir))


@query
def missing_answers(spark, sf_dir):
    runs = _partial_runs(spark, sf_dir)
    # every run's items: as many rows as complete runs have
    wanted = runs.select(*RUN).distinct().join(F.broadcast(synthetic.items(spark, sf_dir).select("item_id")))
    return wanted.join(runs.select(*RUN, "item_id"), [*RUN, "item_id"], "left_anti")


def _gate_scores(spark, sf_dir) -> DataFrame:
    """The scores, with one run of which every second response copies the prompt's example and goes on."""
    copies = (F.col("model") == "m1") & (F.col("prompt_style") == "plain") & (F.col("item_id") % 2 == 0)
    return _scores(spark, sf_dir).withColumn("raw_response", F.when(copies, F.concat(F.trim("prefix"), F.lit("\nx"))).otherwise(F.col("raw_response")))


@query
def gate_rates(spark, sf_dir):
    return rounded(gates.gated(gates.rates(_gate_scores(spark, sf_dir))), "empty_rate", "example_echo_rate", "question_echo_rate", "recoverable_rate")


@query
def gate_funnel(spark, sf_dir):
    return gates.funnel(gates.rates(_gate_scores(spark, sf_dir)), scoring.coverage(synthetic.runs(spark, sf_dir), synthetic.items(spark, sf_dir)))


PAIRED = ("mean_a", "mean_b", "diff", "p", "p_holm")


@query
def rq1_gap(spark, sf_dir):
    return rounded(paired.language_gap(_scores(spark, sf_dir)), *PAIRED)


@query
def rq2_pairs(spark, sf_dir):
    return rounded(paired.model_pairs(_scores(spark, sf_dir), "az"), *PAIRED)


@query
def control_gap(spark, sf_dir):
    control = synthetic.items(spark, sf_dir).where(F.col("category").isin(4, 6))
    return rounded(paired.model_pairs(_scores(spark, sf_dir), "az", control), *PAIRED)


@query
def prompt_verdict(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return paired.prompt_verdict(paired.gap_intervals(s), paired.usable_styles(gates.rates(_gate_scores(spark, sf_dir))))


@query
def gap_closed(spark, sf_dir):
    return rounded(paired.gap_closed(paired.language_gap(_scores(spark, sf_dir))).select("model", "prompt_style", "mode", "closed"), "closed")


@query
def gap_floor_marks(spark, sf_dir):
    em = _scores(spark, sf_dir).where("provenance = 2").groupBy("model", "language").agg(F.avg("em_strict").alias("em"))
    return rounded(em.withColumn("mark", gates.floor_mark(F.col("em"))), "em")


def _excess(spark, sf_dir, interval: str) -> DataFrame:
    pairs = spark.createDataFrame(list(synthetic.PAIRS), "label string, base string, tuned string")
    return rounded(paired.excess_damage(_scores(spark, sf_dir), pairs, interval), "az_loss", "en_loss", "excess", "translit_loss", "cyrillic_share", "low", "high")


@query
def excess_damage(spark, sf_dir):
    """With the normal approximation of its SQL."""
    return _excess(spark, sf_dir, "normal")


@query
def excess_damage_bootstrap(spark, sf_dir):
    """With the percentile bootstrap; without SQL."""
    return _excess(spark, sf_dir, "bootstrap")


@query
def composition_subsets(spark, sf_dir):
    return rounded(paired.subset_gaps(_scores(spark, sf_dir), [4, 6]), "mean_gap")


def _default_scores(spark, sf_dir) -> DataFrame:
    return _scores(spark, sf_dir).where("prompt_style = 'default'").select("model", "language", "item_id", "em_strict")


def _bootstrap(spark, sf_dir, resamples: int) -> DataFrame:
    return rounded(statistics.bootstrap_hash(_default_scores(spark, sf_dir), ["model", "language"], "item_id", "em_strict", resamples=resamples), "mean", "low", "high")


@query
def bootstrap_hash(spark, sf_dir):
    """The 200 resamples of its SQL."""
    return _bootstrap(spark, sf_dir, 200)


@query
def bootstrap_hash_full(spark, sf_dir):
    """At the library's setting."""
    return _bootstrap(spark, sf_dir, statistics.RESAMPLES)


@query
def bootstrap_numpy(spark, sf_dir):
    return statistics.bootstrap_numpy(_default_scores(spark, sf_dir), ["model", "language"], "item_id", "em_strict")


@query
def permutation_numpy(spark, sf_dir):
    s = _default_scores(spark, sf_dir)
    en, az = (s.where(F.col("language") == x).select("model", "item_id", F.col("em_strict").alias(x)) for x in ("en", "az"))
    return statistics.permutation_numpy(en.join(az, ["model", "item_id"]), ["model"], "item_id", "en", "az")


def _nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 37 % 11).cast("double").alias("x"), (F.col("n_nationkey") % 3 == 0).alias("g"))


@query
def exact_permutation(spark, sf_dir):
    """All nations; its SQL lists every arrangement."""
    return rounded(statistics.exact_permutation(_nations(spark, sf_dir), "n_nationkey", "x", "g"), "observed", "p")


@query
def exact_permutation_nations(spark, sf_dir):
    """The same; its SQL counts arrangements by size and sum."""
    return rounded(statistics.exact_permutation(_nations(spark, sf_dir), "n_nationkey", "x", "g"), "observed", "p")


@query
def kappa(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(statistics.cohen_kappa(rows, ["lang"], "quality", "toxic"), "agreement", "kappa")


@query
def null_shuffle_hash(spark, sf_dir):
    """The 20 shuffles of its SQL."""
    return statistics.null_shuffle_hash(synthetic.votes(spark, sf_dir), 20)


@query
def null_shuffle_hash_full(spark, sf_dir):
    """At the usual setting."""
    return statistics.null_shuffle_hash(synthetic.votes(spark, sf_dir), statistics.RESAMPLES)


@query
def key_balance_chi2(spark, sf_dir):
    return rounded(curation.key_balance(synthetic.votes(spark, sf_dir)), "share", "chi_square")


@query
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 100)


@query
def error_sample(spark, sf_dir):
    wrong = _scores(spark, sf_dir).where("em_strict = 0 and model = 'm1' and language = 'az' and prompt_style = 'default'")
    return sampling.error_sample(wrong.select("item_id", "category"), "category", "item_id", 12)


@query
def quota_topk(spark, sf_dir):
    return sampling.quota_top(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 3).select("p_partkey", "p_brand", "rank")


@query
def round_robin(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], 4).select("p_partkey", "p_brand", "turn")


def _leaks(spark, sf_dir, passage: Column) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(passage, STRICT).alias("tokens"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text"), STRICT).alias("tokens"))
    return curation.leaks(shared.written(docs, "tokens"), items)


@query
def leak_check(spark, sf_dir):
    """The openings of 8 words of its SQL."""
    return _leaks(spark, sf_dir, F.array_join(F.slice(F.split("text", " "), 1, 8), " "))


@query
def leak_check_whole(spark, sf_dir):
    """Whole benchmark texts."""
    return _leaks(spark, sf_dir, F.col("text"))


@query
def single_valued_subjects(spark, sf_dir):
    return curation.single_valued(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query
def inflect_aliases(spark, sf_dir):
    w = F.split("text", " ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.struct(F.lit("a").alias("which"), w[0].alias("w")), F.struct(F.lit("b").alias("which"), w[1].alias("w")))).alias("x"))
    word = rows.select("item_id", "x.which", F.regexp_replace("x.w", "[^A-Za-zÀ-ÿ]", "").alias("word"))
    return word.select("item_id", "which", "word", F.array_join(F.filter(F.array_distinct(morphology.all_forms(F.col("word"))), lambda f: f != F.col("word")), ",").alias("forms"))


@query
def ordinal_suffix(spark, sf_dir):
    """The numbers of all orders as ordinals."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("n")).select("n", morphology.ordinal_suffix(F.col("n")).alias("suffix"))


@query
def primes(spark, sf_dir):
    """The primes among the keys of parts."""
    return curation.primes_among(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n")))


@query
def math_items(spark, sf_dir):
    keys = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40 + 3).alias("a"), (F.col("p_partkey") % 50 + 43).alias("b")).distinct()
    return curation.computed_items(keys)


@query
def usage_cost(spark, sf_dir):
    # fixed values: prices for a million tokens
    prices = spark.createDataFrame([("click", 3.0, 15.0), ("view", 0.5, 1.5), ("error", 0.1, 0.4)], "event_type string, price_in double, price_out double")
    e = F.col("event_id")
    used = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(e % 50).alias("input_tokens"), F.sum(e % 7).alias("output_tokens"), F.count_if(e % 11 == 0).alias("failures"))
    usd = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6
    return used.join(F.broadcast(prices), "event_type", "left").select("event_type", "calls", "input_tokens", "output_tokens", "failures", F.round(usd, 9).alias("usd"))


@query
def resume_pending(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return append_log.pending(e, e.where("event_id % 3 = 0"), "event_id")


@query
def stream_append_scores(spark, sf_dir):
    """The benchmark's items as a stream into an append-only log, then the log."""
    base = shared.new_path(spark, "append")
    items = synthetic.items(spark, sf_dir).select("item_id", "answer")
    items.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(items.schema).parquet(f"{base}/in")
    respond = lambda df: df.select("item_id", F.md5("answer").alias("response"), F.lit(False).alias("failed"))
    append_log.run(stream, respond, "item_id", f"{base}/log", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/log")


@query
def duplicate_questions(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text"), STRICT).alias("n")).where("n <> ''")
    h = q.select("doc_id", F.sha2("n", 256).alias("h"))  # the texts themselves needn't move
    first = h.groupBy("h").agg(F.min("doc_id").alias("first"))
    return h.join(first, "h").where("doc_id <> first").select("doc_id", "first")


def _draft_rows(spark, sf_dir, question: Column) -> DataFrame:
    w, d = F.split("text", "[ \\n]+"), F.col("doc_id")
    none: Column = F.array(F.lit("x"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("az-"), F.lpad((d - (d % 50 == 7).cast("int")).cast("string"), 4, "0")).alias("id"), d.alias("line"),
        F.concat(F.array_join(question, " "), F.when(d % 4 == 0, "?").otherwise("")).alias("question_az"), F.lit("q").alias("question_en"),
        F.try_element_at(w, F.when(d % 10 == 0, 2).otherwise(9)).alias("answer"), F.when(d % 9 == 0, "").otherwise("x").alias("answer_en"),
        none.alias("answer_aliases"), F.col("lang").alias("category"), F.lit("s").alias("source"), F.lit("manual").alias("provenance"), F.lit("pending").alias("verified_by"),
    )


@query
def validate_items(spark, sf_dir):
    """Questions of 6 words, as its SQL has them."""
    return curation.validate_items(_draft_rows(spark, sf_dir, F.slice(F.split("text", "[ \\n]+"), 1, 6)))


@query
def validate_items_whole(spark, sf_dir):
    """Whole texts as questions, but for the ninth word where that is the answer."""
    w = F.split("text", "[ \\n]+")
    return curation.validate_items(_draft_rows(spark, sf_dir, F.filter(w, lambda _, i: (F.col("doc_id") % 10 == 0) | (i != 8))))


def _pairs(spark) -> DataFrame:
    return spark.createDataFrame(list(synthetic.PAIRS), "label string, base string, tuned string")


@query
def main_table(spark, sf_dir):
    return rounded(scoring.main_table(_scores(spark, sf_dir)), "em", "em_low", "em_high", "f1", "f1_low", "f1_high", "baseline")


@query
def rq1_intervals(spark, sf_dir):
    return rounded(paired.gap_intervals(_scores(spark, sf_dir)), "mean_a", "mean_b", "diff", "p", "low", "high")


@query
def rq2_intervals(spark, sf_dir):
    return rounded(paired.pair_intervals(_scores(spark, sf_dir), "az"), "mean_a", "mean_b", "diff", "p", "low", "high")


@query
def confirmatory_table(spark, sf_dir):
    return rounded(paired.confirmatory(_scores(spark, sf_dir), _pairs(spark)), "mean_a", "mean_b", "diff", "p", "p_holm", "low", "high")


@query
def pair_gates(spark, sf_dir):
    return paired.pair_gates(gates.rates(_gate_scores(spark, sf_dir)), _pairs(spark))


@query
def error_shares(spark, sf_dir):
    rows = synthetic.runs(spark, sf_dir).select(*RUN, scoring.classify_error(answers.extract_answer(F.col("raw_response")), F.col("golds")).alias("error"))
    return rounded(scoring.error_summary(rows, RUN), "share")


def _choices(spark, sf_dir) -> DataFrame:
    """model, item_id and chosen: letters drawn for every model's items, right in half of the cases."""
    items = synthetic.items(spark, sf_dir).select("item_id", F.explode(F.array(*map(F.lit, synthetic.MODELS))).alias("model"))
    u = statistics.hash_uniform("item_id", "model", F.lit("letter"))
    raw = F.concat(F.when(u % 3 == 0, "Cavab: ").otherwise(""), F.substring(F.lit("ABCD"), (F.col("item_id") % 4 + F.when(u % 2 == 0, 0).otherwise(1) + 1).cast("int"), F.lit(1)), F.lit(") x"))
    return items.select("model", "item_id", (answers.letter_of(raw) == F.substring(F.lit("ABCD"), (F.col("item_id") % 4 + 1).cast("int"), F.lit(1))).cast("double").alias("chosen"))


def _written(spark, sf_dir) -> DataFrame:
    return _scores(spark, sf_dir).where("language = 'az' and prompt_style = 'default'").select("model", "item_id", *[f"em_{m.name}" for m in MODES])


@query
def format_contrast(spark, sf_dir):
    return rounded(scoring.format_contrast(_choices(spark, sf_dir), _written(spark, sf_dir)), "mean_a", "mean_b", "diff", "p", "low", "high")


@query
def retention(spark, sf_dir):
    return rounded(scoring.retention(_choices(spark, sf_dir), _written(spark, sf_dir)), "kept", "low", "high")


@query
def mcq_letter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", answers.letter_of(F.col("text")).alias("letter"), F.md5("text").alias("text_md5"))


@query
def gold_answers(spark, sf_dir):
    golds = lambda g: F.array_join(scoring.gold_answers(F.lit(g), F.col("answer"), F.col("answer_aliases"), F.col("question_en")), "|").alias(f"golds_{g}")
    return synthetic.items(spark, sf_dir).select("item_id", golds("az"), golds("en"))


@query
def answer_present(spark, sf_dir):
    return synthetic.runs(spark, sf_dir).select(*RUN, "item_id", answers.answer_present(F.col("raw_response"), F.col("gold")).alias("present"))


@query
def agreement_by_stratum(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    k = statistics.cohen_kappa(rows, ["source"], "quality", "toxic")
    return rounded(k.withColumn("reading", statistics.interpret_kappa(F.col("kappa"))), "agreement", "kappa")


@query
def kappa_bands(spark, sf_dir):
    """A kappa for each order, by its key: every hundredth from -0.1 to 1, the bounds of the bands among them."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 111 - 10) / 100).alias("kappa"))
    return rows.withColumn("reading", statistics.interpret_kappa(F.col("kappa")))


@query
def prompt_texts(spark, sf_dir):
    template = F.lit("Sual: Misir. Cavab: Qahir\nSual: {question}\n{options}\nCavab:")
    choices = F.array("answer", "answer_en", F.lit("x"), F.lit("y"))
    return synthetic.items(spark, sf_dir).select("item_id", F.md5(prompts.build_choice_prompt(template, F.col("question_az"), choices)).alias("prompt_md5"), prompts.prompt_prefix(template).alias("prefix"))


ORACLES = {k: v for k, v in oracle.ORACLES.items() if k in QUERIES}
