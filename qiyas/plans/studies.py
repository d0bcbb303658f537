"""Queries about declared pairs and resampling, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qiyas.operators import between, gates, paired, statistics
from qiyas.plans import oracle, synthetic
from qiyas.plans.catalogue import Query, _gate_scores, _nations, _scores, rounded
from qiyas.sources import shared

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RULES = {"default first": ("default", "plain"), "plain first": ("plain", "default")}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _study_scores(scores: DataFrame) -> DataFrame:
    """The scores, but with shares of right answers that differ between models and languages as synthetic.SHARES says."""
    share = F.when(F.lit(False), 0)
    for (model, language), v in synthetic.SHARES.items():
        share = share.when((F.col("model") == model) & (F.col("language") == language), v)
    u = statistics.hash_uniform("item_id", "model", "language", "prompt_style", F.lit("study")) % 100
    return scores.withColumn("em_strict", (u < share).cast("double"))


def _declared(spark: SparkSession) -> DataFrame:
    pairs = spark.createDataFrame(list(synthetic.STUDY_PAIRS), "label string, base string, tuned string, script string, target string, name string")
    return pairs.withColumn("base_family", between.base_family(F.col("name")))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair that passes its gates in each style, in points. Scores and pairs are written once, as several steps read them."""
    pairs = _declared(spark)
    columns = ("model", "language", "prompt_style", "item_id", "question", "gold", "prefix", "raw_response", "prediction", "em_strict", "em_translit")
    scores = shared.written(_gate_scores(spark, sf_dir).select(*columns), "scores")
    failed = paired.pair_gates(gates.rates(scores), pairs)
    rows = paired.excess_damage(_study_scores(scores), pairs, failed=failed)
    points = {c: 100 * F.col(c) for c in ("az_loss", "en_loss", "excess", "low", "high")}
    return shared.written(rows.withColumns(points).join(F.broadcast(pairs.select("label", "script", "target", "base_family")), "label"), "measured")


@query
def excess_damage_gated(spark, sf_dir):
    """Pairs that fail a gate in a style have no row there."""
    columns = ["az_loss", "en_loss", "excess", "low", "high"]
    return rounded(_measured(spark, sf_dir).select("label", "prompt_style", "base_family", "n", *columns, "verdict"), *columns)


@query
def pair_accounts(spark, sf_dir):
    rows = between.preferred(_measured(spark, sf_dir), RULES["default first"])
    return rounded(between.test_accounts(rows), "observed", "p_mean", "rank_diff", "p_rank")


@query
def style_sensitivity(spark, sf_dir):
    return rounded(between.sensitivity(_measured(spark, sf_dir), RULES), "p_mean")


@query
def pair_confound(spark, sf_dir):
    return between.confound(between.preferred(_measured(spark, sf_dir), RULES["default first"]))


@query
def exact_ranks_nations(spark, sf_dir):
    """Means and mean ranks over the whole table."""
    rows = _nations(spark, sf_dir).withColumn("all", F.lit("all"))
    return rounded(between.exact_tests(rows, ["all"], "n_nationkey", "x", "g"), "observed", "p_mean", "rank_diff", "p_rank")


@query
def permutation_hash(spark, sf_dir):
    """en against az for each model and style by 10,000 sign flips."""
    key = ["model", "prompt_style", "item_id"]
    s = _scores(spark, sf_dir)
    en, az = (s.where(F.col("language") == g).select(*key, F.col("em_strict").alias(g)) for g in ("en", "az"))
    return rounded(statistics.permutation(en.join(az, key), ["model", "prompt_style"], ["item_id"], "en", "az"), "diff", "p")


@query
def bootstrap_weights(spark, sf_dir):
    """EM and F1 of each run in one pass."""
    out = statistics.bootstrap(_scores(spark, sf_dir), ["model", "language", "prompt_style"], ["item_id"], ["em_strict", "f1_strict"])
    return rounded(out, *[f"{v}_{k}" for v in ("em_strict", "f1_strict") for k in ("mean", "low", "high")])


#: A weight by a uniform number below 2**32: Poisson of mean 1, its distribution function in 2**32ths, from 0 up.
POISSON = [int(sum(1 / math.factorial(j) for j in range(k + 1)) / math.e * 2**32) for k in range(12)]


def boot_weights(source: str, group: str, value: str, name: str, resamples: int = 1000, key: str = "item_id") -> str:
    """name: low and high of the percentile bootstrap of a mean by group, each row weighed by md5 of its key."""
    u = f"('0x' || substr(md5(concat_ws('|', '0', (r // 4)::varchar, {key})), (8 * (r % 4) + 1)::int, 8))::bigint"
    return f"""{name}_w as (select {group}, r, {value} as x, {' + '.join(f'(u >= {t})::int' for t in POISSON)} as w from (select *, {u} as u from {source}, (select unnest(range(0, {resamples})) as r))),
{name}_m as (select {group}, sum(w * x) / nullif(sum(w), 0) as m from {name}_w group by {group}, r),
{name} as (select {group}, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from {name}_m group by all)"""


_STUDY_PAIRS = f"pairs as (select *, case {' '.join(f'''when contains(lower(split_part(name, '/', -1)), '{f}') then '{f.capitalize()}' ''' for f in between.FAMILIES)} else '{between.OTHER_FAMILY}' end as base_family from (values {', '.join(str(p) for p in synthetic.STUDY_PAIRS)}) v(label, base, tuned, script, target, name))"
_SHARE = " ".join(f"when model = '{m}' and language = '{g}' then {v}" for (m, g), v in synthetic.SHARES.items())
_U = oracle.uniform("item_id", "model", "language", "prompt_style", "'study'")
_MEASURED = f"""with {oracle.RATES}, {_STUDY_PAIRS},
failed as (select distinct label, prompt_style from rates join pairs on model in (base, tuned) where example_echo_rate > 0.2 or question_echo_rate > 0.2 or recoverable_rate > 0.3),
study as (select model, language, prompt_style, item_id, ({_U} % 100 < case {_SHARE} end)::int as em from scores),
four as (
  select label, prompt_style, item_id, max(em) filter (model = base and language = 'az') - max(em) filter (model = tuned and language = 'az') as az,
    max(em) filter (model = base and language = 'en') - max(em) filter (model = tuned and language = 'en') as en
  from study join pairs on model in (base, tuned) where (label, prompt_style) not in (select (label, prompt_style) from failed) group by all),
x as (select *, az - en as d from four), {oracle.boot('x', 'label, prompt_style', 'd', 'ci')},
measured as (
  select label, prompt_style, script, target, base_family, count(*) as n, 100 * avg(az) as az_loss, 100 * avg(en) as en_loss, 100 * avg(d) as excess, 100 * any_value(low) as low, 100 * any_value(high) as high
  from x join ci using (label, prompt_style) join pairs using (label) group by all)"""
_VERDICT = "case when low > 0 and az_loss > 0 then 'damaged' when low > 0 then 'gained less' when high < 0 and az_loss > 0 then 'lost less' when high < 0 then 'spared' else 'no difference' end"
ORACLES["excess_damage_gated"] = f"{_MEASURED} select {oracle.rounded('label, prompt_style, base_family, n', 'az_loss', 'en_loss', 'excess', 'low', 'high')}, {_VERDICT} as verdict from measured"


def _tested(rules: dict[str, tuple[str, ...]]) -> str:
    """CTEs that end in tested(rule, account, pairs, correct, observed, p_mean, rank_diff, p_rank, arrangements): every choice of pairs is a bit mask."""
    chosen = " union all ".join(f"(select distinct on (label) '{k}' as rule, * from measured order by label, list_position({list(v)}, prompt_style))" for k, v in rules.items())
    return f"""{_MEASURED}, chosen as ({chosen}),
said as (
  select rule, label, excess, low > 0 and az_loss > 0 as damaged, unnest(['script', 'base family', 'strength', 'kinship']) as account,
    unnest([script = 'kiril', base_family = 'Qwen', abs(az_loss) + abs(en_loss) > 3.5, target in ('qazax', 'türk')]) as inside from chosen),
ranked as (select *, rank() over (partition by rule, account order by excess) as rk, row_number() over (partition by rule, account order by label) - 1 as i from said),
groups as (select rule, account, count(*) as pairs, count(*) filter (inside) as k, count(*) filter (inside = damaged) as correct, sum(excess) as total, sum(rk) as ranks from ranked group by all having bool_or(inside) and not bool_and(inside)),
masks as (select rule, account, unnest(range(0, 1 << pairs::int))::bigint as m, pairs, k, total, ranks from groups),
sums as (
  select rule, account, m, sum(excess) filter ((m >> i::int) & 1 = 1) as s, sum(rk) filter ((m >> i::int) & 1 = 1) as r, any_value(pairs) as n, any_value(k) as k, any_value(total) as total, any_value(ranks) as ranks
  from masks join ranked using (rule, account) where bit_count(m) = k group by all),
stats as (select rule, account, s / k - (total - s) / (n - k) as st, r / k - (ranks - r) / (n - k) as rt from sums),
seen as (select rule, account, avg(excess) filter (inside) - avg(excess) filter (not inside) as observed, avg(rk) filter (inside) - avg(rk) filter (not inside) as rank_diff from ranked group by all),
tested as (
  select rule, account, pairs, correct, observed, count(*) filter (abs(st) >= abs(observed) - 1e-9) / count(*) as p_mean, rank_diff,
    count(*) filter (abs(rt) >= abs(rank_diff) - 1e-9) / count(*) as p_rank, count(*) as arrangements
  from stats join seen using (rule, account) join groups using (rule, account) group by all)"""


ORACLES["pair_accounts"] = f"{_tested({'default first': RULES['default first']})} select {oracle.rounded('account, pairs, correct, arrangements', 'observed', 'p_mean', 'rank_diff', 'p_rank')} from tested"
ORACLES["style_sensitivity"] = f"{_tested(RULES)} select rule, account, pairs, correct, round(p_mean, 9) as p_mean from tested where account in ('script', 'base family') and pairs >= 4 and rule in (select rule from tested where account in ('script', 'base family') and pairs >= 4 group by rule having count(*) = 2)"
ORACLES["pair_confound"] = f"{_tested({'default first': RULES['default first']})} select count(*) as damaged, count(distinct base_family) as families, count(*) > 0 and count(distinct base_family) = 1 as one_family from chosen where low > 0 and az_loss > 0"
ORACLES["exact_ranks_nations"] = f"""with recursive v as (
  select row_number() over (order by n_nationkey) as i, x, (rank() over (order by x))::int as rk, n_nationkey % 3 = 0 as g from (select *, n_nationkey * 37 % 11 as x from nation)),
{'''
'''.join(f'''{n} as (select 0::bigint as i, 0 as k, 0 as s, 1::bigint as c
  union all select i, k, s, sum(c)::bigint from (select t.i + 1 as i, t.k + b as k, t.s + b * v.{c} as s, t.c from {n} t join v on v.i = t.i + 1 cross join (select unnest([0, 1]) as b)) group by i, k, s),
{n}_o as (select count(*) as n, count(*) filter (g) as k, sum({c}) as total, sum({c}) filter (g) as inside from v),
{n}_e as (select t.c, t.s / o.k - (o.total - t.s) / (o.n - o.k) as st, o.inside / o.k - (o.total - o.inside) / (o.n - o.k) as ob from {n} t, {n}_o o where t.i = o.n and t.k = o.k),
{n}_p as (select round(ob, 9) as ob, round(sum(c) filter (abs(st) >= abs(ob) - 1e-9) / sum(c), 9) as p, sum(c)::bigint as arrangements from {n}_e group by ob),''' for n, c in (('m', 'x'), ('r', 'rk')))}
z as (select 1) select 'all' as all, m_p.ob as observed, m_p.p as p_mean, r_p.ob as rank_diff, r_p.p as p_rank, m_p.arrangements from m_p, r_p"""
_SIGN = "substr(md5(concat_ws('|', '0', (r // 32)::varchar, item_id)), (r % 32 + 1)::int, 1) < '8'"
ORACLES["permutation_hash"] = f"""with {oracle.RUNS}, {oracle.GAPS}, whole as (select model, prompt_style, count(*) as n, avg(d) as diff, sum(d) as total from gaps group by all),
signed as (select model, prompt_style, r, sum(case when {_SIGN} then d else -d end) as s from gaps, (select unnest(range(0, 10000)) as r) where d <> 0 group by all),
hits as (select model, prompt_style, count(*) filter (abs(s) / n >= abs(total) / n - 1e-12) as hits from signed join whole using (model, prompt_style) group by all)
select model, prompt_style, n, round(diff, 9) + 0.0 as diff, round((coalesce(hits, 10000) + 1) / 10001, 9) as p from whole left join hits using (model, prompt_style)"""
ORACLES["bootstrap_weights"] = f"""with {oracle.RUNS}, {boot_weights('scores', oracle.RUN, 'em_strict', 'e')}, {boot_weights('scores', oracle.RUN, 'f1_strict', 'f')}
select {oracle.RUN}, count(*) as n, round(avg(em_strict), 9) as em_strict_mean, round(any_value(e.low), 9) as em_strict_low, round(any_value(e.high), 9) as em_strict_high,
  round(avg(f1_strict), 9) as f1_strict_mean, round(any_value(f.low), 9) as f1_strict_low, round(any_value(f.high), 9) as f1_strict_high
from scores join e using ({oracle.RUN}) join f using ({oracle.RUN}) group by {oracle.RUN}"""
