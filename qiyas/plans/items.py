"""Queries that make items out of facts and of multiple-choice rows, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qiyas.functions.text import STRICT
from qiyas.operators import curation, facts, numbering
from qiyas.plans import oracle
from qiyas.plans.catalogue import Query, rounded, table
from qiyas.sources import shared

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ENTITY = "http://www.wikidata.org/entity/Q"

TEMPLATES = (
    facts.Template("country_region", "geography", "country", "region", (("{subject_gen} bölgəsi hansıdır?", "What is the region of {subject}?"), ("{subject_loc} hansı bölgə var?", "{subject} is in which region?"), ("{subject} haradadır?", "Where is {subject}?")), difficulty="easy"),
    facts.Template("factory_place", "world", "factory", "located", (("{subject_gen} yeri haradır?", "where is {subject} located?"), ("{subject} hansı ölkədədir?", "Which country is {subject} in?"))),
    facts.Template("part_size", "science", "part", "size", (("{subject} nə boydadır?", "How large is {subject}?"),), literal=True, least_links=10),
)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, suppliers and parts as a graph, with labels of all kinds: Cyrillic, copied, in brackets, missing, within one another.

    Written once: a pattern reads it three times, and a plan that made it each time would take the driver's memory.
    """
    node = lambda n: F.concat(F.lit(ENTITY), n.cast("string"))
    letter = lambda k: F.char(97 + k % 26)

    def of(df: DataFrame, subject, *triples) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), o.cast("string").alias("object"), F.lit(g).alias("lang")) for p, o, g in triples]))
        return df.select(subject.alias("subject"), each.alias("t")).select("subject", "t.*").where("object is not null")

    k = F.col("n_nationkey")
    nation = of(
        table(spark, sf_dir, "nation"), node(1000 + k), (facts.KIND, F.lit("country"), None), ("region", node(F.col("n_regionkey")), None), (facts.LINKS, 5 + k * 7 % 40, None),
        (facts.LABEL, F.concat(F.when(k % 9 == 3, "Ц").otherwise("X"), letter(k), F.when(k % 9 == 7, " (yeni)").otherwise(""), F.lit(" Məmləkət")), "az"),
        (facts.LABEL, F.when(k % 9 == 5, F.concat(F.lit("X"), letter(k), F.lit(" Məmləkət"))).when(k != 24, F.concat(F.lit("Country "), letter(k))), "en"), (facts.LABEL, F.concat(F.lit("Land "), letter(k)), "mul"),
    )
    r = F.col("r_regionkey")
    region = of(table(spark, sf_dir, "region"), node(r), (facts.LABEL, F.when(r == 0, "Qahirə").when(r == 1, "İran").otherwise(F.concat(letter(r), F.lit(" Bölgə"))), "az"), (facts.LABEL, F.concat(F.lit("Region "), letter(r)), "en"))
    s, at = F.col("s_suppkey"), F.col("s_nationkey")
    supplier = of(
        table(spark, sf_dir, "supplier"), node(2000 + s), (facts.KIND, F.lit("factory"), None), ("located", node(1000 + at), None), ("located", F.when(s % 10 == 0, node(1000 + (at + 1) % 25)), None),
        (facts.LINKS, s % 20, None), (facts.LABEL, F.concat(F.when(s % 7 == 1, F.concat(F.lit("X"), letter(at), F.lit(" "))).otherwise(""), F.lit("F"), s.cast("string"), F.lit(" Zavod")), "az"), (facts.LABEL, F.concat(F.lit("factory "), s.cast("string")), "en"),
    )
    p = F.col("p_partkey")
    part = of(table(spark, sf_dir, "part"), node(1000000 + p), (facts.KIND, F.when(p % 2 == 0, "part"), None), ("size", F.col("p_size"), None), (facts.LINKS, 8 + p % 5, None), (facts.LABEL, F.concat(F.lit("hissə N"), p.cast("string")), "az"), (facts.LABEL, F.concat(F.lit("part N"), p.cast("string")), "en"))
    return shared.written(reduce(DataFrame.unionByName, (nation, region, supplier, part)), "triples")


_L = "chr((97 + {} % 26)::int)"
_TRIPLES = f"""nat as (select *, n_nationkey as k, {_L.format('n_nationkey')} as l from nation),
triples as (
  select s as subject, p as property, o as object, g as lang from (
    select '{ENTITY}' || (1000 + k) as s, unnest(['kind', 'region', 'links', 'label', 'label', 'label']) as p, unnest([null, null, null, 'az', 'en', 'mul']) as g,
      unnest(['country', '{ENTITY}' || n_regionkey, (5 + k * 7 % 40)::varchar, case when k % 9 = 3 then 'Ц' else 'X' end || l || case when k % 9 = 7 then ' (yeni)' else '' end || ' Məmləkət',
        case when k % 9 = 5 then 'X' || l || ' Məmləkət' when k <> 24 then 'Country ' || l end, 'Land ' || l]) as o from nat
    union all select '{ENTITY}' || r_regionkey, unnest(['label', 'label']), unnest(['az', 'en']), unnest([case r_regionkey when 0 then 'Qahirə' when 1 then 'İran' else {_L.format('r_regionkey')} || ' Bölgə' end, 'Region ' || {_L.format('r_regionkey')}]) from region
    union all select '{ENTITY}' || (2000 + s_suppkey), unnest(['kind', 'located', 'located', 'links', 'label', 'label']), unnest([null, null, null, null, 'az', 'en']),
      unnest(['factory', '{ENTITY}' || (1000 + s_nationkey), case when s_suppkey % 10 = 0 then '{ENTITY}' || (1000 + (s_nationkey + 1) % 25) end, (s_suppkey % 20)::varchar,
        case when s_suppkey % 7 = 1 then 'X' || {_L.format('s_nationkey')} || ' ' else '' end || 'F' || s_suppkey || ' Zavod', 'factory ' || s_suppkey]) from supplier
    union all select '{ENTITY}' || (1000000 + p_partkey), unnest(['kind', 'size', 'links', 'label', 'label']), unnest([null, null, null, 'az', 'en']),
      unnest([case when p_partkey % 2 = 0 then 'part' end, p_size::varchar, (8 + p_partkey % 5)::varchar, 'hissə N' || p_partkey, 'part N' || p_partkey]) from part)
  where o is not null),
names_az as (select subject as node, min(object) as name from triples where property = 'label' and lang = 'az' group by 1),
names_en as (select subject as node, arg_min(object, case lang when 'en' then 1 else 2 end) as name from triples where property = 'label' and lang in ('en', 'mul') group by 1)"""


def _bound(t: facts.Template, one_value: bool) -> str:
    """SQL of a template's bindings."""
    only = "group by 1 having count(distinct object) = 1" if one_value else "group by subject, object"
    names = "f.answer as answer_az, f.answer as answer_en" if t.literal else "aa.name as answer_az, ae.name as answer_en"
    joins = "" if t.literal else "join names_az aa on aa.node = f.answer join names_en ae on ae.node = f.answer"
    return f"""select f.subject, sa.name as subject_az, se.name as subject_en, {names}, l.links
  from (select subject, min(object) as answer from triples where property = '{t.prop}' {only}) f
  join (select subject from triples where property = 'kind' and object = '{t.kind}') using (subject)
  join (select subject, max(object::bigint) as links from triples where property = 'links' group by 1 having max(object::bigint) >= {t.least_links}) l using (subject)
  join names_az sa on sa.node = f.subject join names_en se on se.node = f.subject {joins}"""


def _judged(bound: str) -> str:
    """SQL of the filter rules over bindings, with the columns of bindings and reason."""
    a, s = (oracle.norm(c, STRICT) for c in ("answer_az", "subject_az"))
    usable = " and ".join(f"not regexp_matches({c}, '[()]') and not regexp_matches({c}, '^Q[0-9]+$') and length({c}) between 1 and 60 and not regexp_matches({c}, '(siyahısı|kateqoriyası|şablonu)$')" for c in ("subject_az", "subject_en", "answer_az", "answer_en"))
    english = " and ".join(f"not regexp_matches({x}_en, '[əğışƏĞŞİ]') and not ({x}_en = {x}_az and regexp_matches({x}_en, '[əğıöşüçƏĞİÖŞÜÇ]'))" for x in ("subject", "answer"))
    cyrillic = "regexp_matches(answer_az || subject_az, '[\\x{0400}-\\x{04FF}]')"
    blocked = ", ".join(f"'{b}'" for b in curation.BLOCKED)
    return f"""select * exclude (a, s, several, again, early), case when early is not null then early when row_number() over (partition by a, early is null order by links desc, subject) > 3 then 'over_quota' end as reason
from (select *, case when several > 1 then 'multi_valued' when again > 1 then 'duplicate_subject' when not ({usable}) then 'bad_label' when {cyrillic} then 'cyrillic_answer' when not ({english}) then 'en_label_not_english'
    when a in ({blocked}) then 'blocked_answer' when a in ('qahirə', 'cairo', 'h2o') then 'prompt_example' when len(string_split(a, ' ')) > 3 then 'answer_too_long' when a = s then 'answer_equals_subject'
    when contains(' ' || s || ' ', ' ' || a || ' ') or list_contains(string_split(s, ' '), string_split(a, ' ')[1]) then 'answer_inside_subject' end as early
  from (select *, {a} as a, {s} as s, count(distinct answer_az) over (partition by subject) as several, row_number() over (partition by subject order by links desc, answer_az) as again from ({bound})))"""


@query
def filter_reasons(spark, sf_dir):
    """Why each candidate is kept or not, subjects with several values among them."""
    triples = _triples(spark, sf_dir)
    located = facts.bindings(triples, facts.Template("all", "world", "factory", "located", TEMPLATES[1].wordings, one_value=False, least_links=0), en=("en", "mul"))
    regions = facts.bindings(triples, facts.Template("all", "world", "country", "region", TEMPLATES[0].wordings, least_links=0), en=("en", "mul"))
    # written, so that finding and judging are two plans
    return facts.candidates(shared.written(located.unionByName(regions), "bindings")).select("subject", "subject_az", "subject_en", "answer_az", "answer_en", "links", "reason")


@query
def filter_stats(spark, sf_dir):
    return facts.filter_stats(filter_reasons(spark, sf_dir))


_LOOSE = [_bound(facts.Template("all", "world", k, p, (), one_value=one, least_links=0), one) for k, p, one in (("factory", "located", False), ("country", "region", True))]
_REASONS = f"with {_TRIPLES} {_judged(' union all '.join(_LOOSE))}"
ORACLES["filter_reasons"] = _REASONS
ORACLES["filter_stats"] = f"select coalesce(reason, 'kept') as reason, count(*) as n from ({_REASONS}) where reason is distinct from 'duplicate_subject' group by 1"


def _reviewed(spark, sf_dir) -> DataFrame:
    """Addresses of every fourth factory as in earlier drafts, some with a slash at the end, beside other hosts."""
    s = F.col("s_suppkey")
    source = F.when(s % 4 == 0, F.concat(F.lit("https://www.wikidata.org/wiki/Q"), (2000 + s).cast("string"), F.when(s % 8 == 0, "/").otherwise(""))).otherwise(F.concat(F.lit("https://example.org/Q"), (2000 + s).cast("string")))
    return table(spark, sf_dir, "supplier").select(source.alias("source"))


def _drafts(spark, sf_dir) -> DataFrame:
    triples, done, start, out = _triples(spark, sf_dir), facts.reviewed(_reviewed(spark, sf_dir)), 1, []
    for t in TEMPLATES:
        found = shared.written(facts.bindings(triples, t, en=("en", "mul")), "bindings")
        out.append(facts.items(facts.candidates(found, done), t, start))
        start += out[-1].count()
    return reduce(DataFrame.unionByName, out)


@query
def fact_items(spark, sf_dir):
    """Drafts of three templates, numbered on from one to the next."""
    return _drafts(spark, sf_dir).select("id", "question_az", "question_en", "answer", "answer_en", "category", "source", "difficulty", "notes")


@query
def answer_skew(spark, sf_dir):
    return rounded(facts.answer_skew(_drafts(spark, sf_dir)), "share")


def _item_sql(t: facts.Template, place: int) -> str:
    """SQL of a template's drafts; the labels end in words whose genitive and locative are known."""
    forms = {"{subject_gen}": {"country": "'in'", "factory": "'un'"}.get(t.kind or ""), "{subject_loc}": {"country": "'də'", "factory": "'da'"}.get(t.kind or ""), "{subject}": "''"}

    def said(wording: str, name: str) -> str:
        for field, end in forms.items():
            if field in wording:
                before, after = wording.split(field)
                return f"'{before}' || {name} || {end} || '{after}'"
        return f"'{wording}'"

    turn = f"((rn - 1) % {len(t.wordings)} + 1)::int"
    az, en = (f"[{', '.join(said(w[i], n) for w in t.wordings)}][{turn}]" for i, n in ((0, "subject_az"), (1, "subject_en")))
    up = lambda q: f"upper(left({q}, 1)) || substr({q}, 2)"
    return f"""select {place} as place, rn, {up(az)} as question_az, {up(en)} as question_en, answer_az as answer, answer_en, '{t.category}' as category,
  replace(subject, 'http://www.wikidata.org/entity/', 'https://www.wikidata.org/wiki/') as source, '{t.difficulty}' as difficulty, 'template={t.name};variant=' || ({turn} - 1) as notes
from (select *, row_number() over (order by links desc, subject) as rn from ({_judged(_bound(t, True))}) where reason is null and not exists (select 1 from supplier where s_suppkey % 4 = 0 and subject = '{ENTITY}' || (2000 + s_suppkey)))"""


_ITEMS = f"with {_TRIPLES}, drafts as ({' union all '.join(_item_sql(t, k) for k, t in enumerate(TEMPLATES))})"
ORACLES["fact_items"] = f"{_ITEMS} select printf('az-%03d', row_number() over (order by place, rn)) as id, * exclude (place, rn) from drafts"
ORACLES["answer_skew"] = f"""{_ITEMS}, c as (select {oracle.norm('answer', STRICT)} as a, count(*) as n from drafts group by 1)
select sum(n)::bigint as items, count(*) as answers, arg_max(a, (n, a)) as top_answer, round(max(n) / sum(n), 9) as share, max(n) / sum(n) > 0.15 as skewed from c"""

#: What is odd about the question, the answer or the choices of every twentieth part, by the remainder.
_QUESTIONS = {5: "Kütlə 0, 8 kq olan cisim hansıdır, deyin?", 6: "Aşağıdakılardan hansı bərk maddədir, seçin?", 7: "Qısa sual?", 16: "Hansı qonşudur, BU ÖLKƏ ilə həmsərhəd olan?", 17: "Hansı cisim bərk maddə deyil: "}
_ANSWERS = {9: "Heç biri", 10: "a b c d e f g", 11: "1, 2, 4", 12: "I, III, IV", 13: "q=it", 14: "mgh/2", 15: "km/saat", 18: "25kN"}


def _choice_rows(spark, sf_dir) -> DataFrame:
    p, kind = F.col("p_partkey"), F.col("p_partkey") % 20
    text = lambda c: c.cast("string")
    plain = F.concat("p_name", F.lit(" hansı "), F.lower("p_type"), F.lit(" ölçüsündədir, "), text(p), F.lit("?"))
    question, answer = plain, F.concat("p_brand", F.lit(" x"))
    for k, v in _QUESTIONS.items():
        question = F.when(kind == k, F.lit(v) if k == 7 else F.concat(F.lit(v[:-1]), F.lit(" "), text(p), F.lit(v[-1])) if k != 17 else F.concat(text(p), F.lit(" " + v))).otherwise(question)
    for k, v in _ANSWERS.items():
        answer = F.when(kind == k, v).otherwise(answer)
    answer = F.when(kind == 8, F.col("p_name")).otherwise(answer)
    other = [F.concat(F.lit(f"{x} "), text(p)) for x in "uvw"]
    other[0] = F.when(kind == 2, F.lit(" ")).when(kind == 3, other[1]).when(kind == 4, F.lit("3,")).otherwise(other[0])
    place = (p % 4).cast("int")
    wrong = F.array(*other)
    choices = F.concat(F.slice(wrong, F.lit(1), place), F.array(F.concat(F.lit(" "), answer)), F.slice(wrong, place + 1, F.lit(4)))
    letter = F.when(kind == 0, "E").otherwise(F.substring(F.lit("ABCD"), place + 1, F.lit(1)))
    return table(spark, sf_dir, "part").select(p.alias("item_id"), question.alias("question"), F.when(kind == 1, F.slice(choices, 1, 3)).otherwise(choices).alias("choices"), letter.alias("letter"), F.col("p_type").alias("subject"), F.lit("test").alias("split"))


@query
def mcq_defects(spark, sf_dir):
    return curation.choice_defects(_choice_rows(spark, sf_dir)).select("item_id", F.array_join("issues", ",").alias("issues"))


@query
def balanced_choices(spark, sf_dir):
    drafts = curation.short_answers(curation.choice_defects(_choice_rows(spark, sf_dir)), "made of parts", "none")
    return drafts.select("id", "question_az", "answer", F.array_join("answer_aliases", "|").alias("answer_aliases"), F.array_join("choices", "|").alias("choices"), "answer_letter", "subject")


def _cases(values: dict[int, str], default: str) -> str:
    return f"case p_partkey % 20 {' '.join(f'when {k} then {v}' for k, v in values.items())} else {default} end"


_Q = {k: f"'{v}'" if k == 7 else f"p_partkey || ' {v}'" if k == 17 else f"'{v[:-1]} ' || p_partkey || '{v[-1]}'" for k, v in _QUESTIONS.items()}
_END = "([^\\p{L}\\p{N}_]|$)"
_REFERS = f"(?i)aşağıdak|aşağıda (göstər|veril)|yuxarıda|verilmişlərdən|bunlardan|hansı sırada|hansı bənd|verilmiş[\\p{{L}}\\p{{N}}_]*dən hansı|(^|[^\\p{{L}}\\p{{N}}_])biri(si)?{_END}|(^|[^\\p{{L}}\\p{{N}}_])bu (ölkə|şəhər|dövlət|maddə|element|bənd|söz){_END}|(deyil|olmayan|olmayanı|yoxdur)\\s*[:?.]?\\s*$"
_UNIT_LETTERS = "A-Za-zƏĞİÖŞÇÜəğıöşçü"
_MCQ = f"""with q as (
  select p_partkey as item_id, p_type as subject, trim({_cases(_Q, "p_name || ' hansı ' || lower(p_type) || ' ölçüsündədir, ' || p_partkey || '?'")}) as question, {_cases({k: f"'{v}'" for k, v in _ANSWERS.items()} | {8: 'p_name'}, "p_brand || ' x'")} as answer0,
    [{_cases({2: "''", 3: "'v ' || p_partkey", 4: "'3,'"}, "'u ' || p_partkey")}, 'v ' || p_partkey, 'w ' || p_partkey] as wrong, (p_partkey % 4)::int as spot from part),
c as (select *, list_concat(wrong[1:spot], [answer0], wrong[spot + 1:]) as full_choices, case when item_id % 20 = 0 then 'E' else substr('ABCD', spot + 1, 1) end as letter from q),
d as (select *, case when item_id % 20 = 1 then full_choices[1:3] else full_choices end as choices from c),
b as (select *, coalesce(choices[nullif(strpos('ABCD', letter), 0)], '') as answer, list_filter([
    case when letter not in ('A', 'B', 'C', 'D') then 'bad_key' end, case when len(choices) <> 4 then 'choice_count' end, case when list_contains(choices, '') then 'empty_choice' end,
    case when len(list_distinct(choices)) < len(choices) then 'duplicate_choice' end, case when len(list_filter(choices, lambda x: regexp_matches(x, '^-?[0-9]+,$'))) > 0 then 'comma_split' end,
    case when regexp_matches(question, '[0-9],\\s+[0-9]') then 'broken_decimal' end, case when regexp_matches(question, '{_REFERS}') then 'list_reference' end, case when length(question) < 25 then 'too_short' end], lambda x: x is not null) as base from d),
e as (select *, case when len(base) > 0 then [] else list_filter([
    case when length(answer) > 2 and contains(lower(question), lower(answer)) then 'answer_in_question' end,
    case when regexp_matches(answer, '(?i)heç ?bir|hamısı|yuxarıda|düzgün cavab|hər ikisi|variant') then 'meta_answer' when len(string_split(answer, ' ')) > 6 then 'long_answer'
      when regexp_matches(answer, '^\\s*[0-9]\\s*(,\\s*[0-9]\\s*)+$|^[IVX]+[a-z]?([,.\\s]+[IVX]+[a-z]?)+\\s*$') then 'enum_answer'
      when regexp_matches(answer, '[=√∏∆<>^+]') or (contains(answer, '/') and not regexp_matches(answer, '[{_UNIT_LETTERS}]/[{_UNIT_LETTERS}]')) then 'formula_answer' end], lambda x: x is not null) end as later,
    row_number() over (partition by lower(question) order by item_id) > 1 as again from b),
defects as (select *, list_concat(base, later, case when again then ['duplicate_question'] else [] end) as issues from e)"""
ORACLES["mcq_defects"] = f"{_MCQ} select item_id, array_to_string(issues, ',') as issues from defects"
ORACLES["balanced_choices"] = f"""{_MCQ}, u as (select *, row_number() over (order by item_id) - 1 as k from defects where len(issues) = 0),
o as (select *, list_transform(list_sort(list_transform(list_filter(choices, lambda x: x <> answer), lambda x: {{'h': md5('0|' || item_id || '|' || x), 'c': x}})), lambda x: x.c) as others, (k % 4)::int as place from u)
select 'tumlu-az-' || (k + 1) as id, question as question_az, answer, case when regexp_matches(answer, '[0-9][{_UNIT_LETTERS}]{{1,6}}') then regexp_replace(answer, '([0-9])([{_UNIT_LETTERS}]{{1,6}})', '\\1 \\2', 'g') else '' end as answer_aliases,
  array_to_string(list_concat(others[1:place], [answer], others[place + 1:]), '|') as choices, substr('ABCD', place + 1, 1) as answer_letter, subject from o"""


@query
def numbered_items(spark, sf_dir):
    """Orders, numbered by price and key over the whole table, and the turn of each among four."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return numbering.turns(numbering.numbered(rows, [F.desc("o_totalprice"), "o_orderkey"], "number", 1), ["number"], 4).select("o_orderkey", "number", "turn")


ORACLES["numbered_items"] = "select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as number, ((row_number() over (order by o_totalprice desc, o_orderkey) - 1) % 4)::int as turn from orders"
