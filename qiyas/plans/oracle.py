"""DuckDB SQL of the catalogue's queries, written from their definitions; letter tables and synthetic constants are the library's own."""

from __future__ import annotations

from qiyas.functions import morphology, text
from qiyas.functions.text import MODES, Mode
from qiyas.plans import synthetic as syn


def uniform(*parts: str) -> str:
    return f"('0x' || left(md5(concat_ws('|', {', '.join(parts)})), 8))::bigint"


def tokens(x: str, mode: Mode) -> str:
    c = f"regexp_replace(lower(translate(coalesce({x}, ''), 'Iİ', 'ıi')), '[\\p{{P}}\\p{{S}}]', ' ', 'g')"
    if mode.translit:
        c = f"translate({c}, '{text.ONE_TO_ONE + text.DELETED}', '{text.ONE_TO_ONE_TO}')"
        for k, v in text.ONE_TO_MANY.items():
            c = f"replace({c}, '{k}', '{v}')"
    if mode.fold:
        c = f"translate({c}, '{text.FOLD_FROM}', '{text.FOLD_TO}')"
    c = f"list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> '')"
    if mode.strip:
        strip = "t"
        for _ in range(text.STRIPS):
            strip = f"regexp_replace({strip}, '{text.suffix_pattern(mode.fold)}', '\\1')"
        c = f"list_transform({c}, lambda t: {strip})"
    return c


def norm(x: str, mode: Mode) -> str:
    return f"array_to_string({tokens(x, mode)}, ' ')"



def f1(a: str, b: str) -> str:
    """Multiset F1 of two lists that are columns."""
    common = f"coalesce(list_sum(list_transform(list_distinct({b}), lambda t: least(len(list_filter({a}, lambda y: y = t)), len(list_filter({b}, lambda y: y = t))))), 0)"
    return f"case when len({a}) = 0 or len({b}) = 0 then (len({a}) = 0 and len({b}) = 0)::int::double when {common} = 0 then 0.0 else 2.0 * ({common} / len({a})) * ({common} / len({b})) / ({common} / len({a}) + {common} / len({b})) end"


def extracted(x: str) -> str:
    line = f"coalesce(list_filter(string_split_regex(trim(coalesce({x}, ''), ' ' || chr(10) || chr(9)), '[\\n\\r]'), lambda l: trim(l) <> '')[1], '')"
    line = f"regexp_replace(trim({line}), '\\*{{1,3}}|_{{1,3}}|`+', '', 'g')"
    line = f"trim(regexp_replace({line}, '(?i)^\\s*(?:(?:cavab|cavabı|answer|a)\\s*[:\\-—]|the answer is\\b|cavab budur\\b)\\s*[:\\-—]?\\s*', ''))"
    line = f"trim({line}, '\"“”«»''')"
    return line


def extract_final(line: str) -> str:
    words = f"len(list_filter(string_split_regex({line}, '\\s+'), lambda w: w <> ''))"
    first = f"case when regexp_matches({line}, '[.!?]\\s') then regexp_extract({line}, '^(.*?[.!?])\\s', 1) else {line} end"
    return f"trim(regexp_replace(case when {words} > 12 then {first} else {line} end, '[.!?,;:]+\\s*$', ''))"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ITEMS = """items as (
  select item_id, w[1] as answer, w[2] as answer_en, [w[1] || 'da', w[1] || 'dan'] as aliases,
    array_to_string(w[3:12], ' ') as question_az, array_to_string(w[4:13], ' ') as question_en,
    (item_id % 7)::int as category, (item_id % 3)::int as provenance
  from (select item_id, string_split(text, ' ') as w from benchmark))"""

RUNS = f"""{ITEMS},
cells as (
  select i.*, j.answer as o_az, j.answer_en as o_en, m.model, l.language, s.prompt_style
  from items i join items j on j.item_id = (i.item_id + 1) % (select count(*) from items)
  cross join (select unnest({list(syn.MODELS)}) as model) m cross join (select unnest({list(syn.LANGUAGES)}) as language) l
  cross join (select unnest({list(syn.STYLES)}) as prompt_style) s),
drawn as (
  select *, case language when 'az' then answer else answer_en end as gold, case language when 'az' then o_az else o_en end as other,
    case language when 'az' then question_az else question_en end as question,
    case language when 'az' then list_concat([answer], aliases) else [answer_en] end as golds,
    case language when 'az' then {q(syn.PREFIX['az'])} else {q(syn.PREFIX['en'])} end as prefix,
    {syn.RIGHT} - {syn.STEP} * substr(model, 2, 1)::int - case language when 'az' then {syn.AZ} else 0 end as r,
    {uniform('item_id', 'model', 'language', 'prompt_style')} % 100 as u
  from cells),
runs as (
  select model, language, prompt_style, item_id, category, provenance, question, gold, golds, prefix,
    case when u < r then gold when u < r + 4 then '"' || gold || '"' when u < r + 8 then gold || 'lar' when u < r + 12 then 'Cavab: ' || gold || '.'
      when u < r + 16 then translate(lower(gold), '{syn.LATIN}', '{syn.LOOKALIKE}') when u < r + 18 then question when u < r + 20 then ''
      when u < r + 23 then 'the answer could be ' || gold || ' or not' else other end as raw_response
  from drawn),
lined as (select *, {extracted('raw_response')} as line from runs),
predicted as (select *, {extract_final('line')} as prediction from lined),
exploded as (select *, unnest(golds) as g from predicted),
normed as (select *, {', '.join(f"{tokens('prediction', m)} as p_{m.name}, {tokens('g', m)} as g_{m.name}" for m in MODES)} from exploded),
scores as (
  select model, language, prompt_style, item_id, category, provenance, question, gold, prefix, raw_response, prediction,
    {', '.join(f"max((array_to_string(p_{m.name}, ' ') = array_to_string(g_{m.name}, ' '))::int::double) as em_{m.name}, max({f1(f'p_{m.name}', f'g_{m.name}')}) as f1_{m.name}" for m in MODES)}
  from normed group by all),
long as (
  {' union all '.join(f"select model, language, prompt_style, item_id, '{m.name}' as mode, {i} as mode_order, em_{m.name} as em from scores" for i, m in enumerate(MODES))})"""

RUN = "model, language, prompt_style"


def flip(m: str, d: str) -> str:
    term = f"exp(lgamma({m} + 1) - lgamma(k + 1) - lgamma({m} - k + 1) - {m} * ln(2))"
    return f"case when {d} = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range((({m} + abs({d})) / 2)::bigint, {m} + 1), lambda k: {term}))) end"


def paired(pairs: str, group: str) -> str:
    return f"""summed as (
  select {group}, count(*) as n, avg(a) as mean_a, avg(b) as mean_b, avg(a - b) as diff, (count(*) filter (a <> b))::bigint as discordant, sum(a - b)::bigint as net
  from ({pairs}) group by {group}),
tested as (select *, {flip('discordant', 'net')} as p from summed)"""


def with_holm(source: str, order: str, family: str = "1") -> str:
    return f"""ranked as (select *, row_number() over (partition by {family} order by p, {order}) as rk, count(*) over (partition by {family}) as fam from {source}),
corrected as (select * exclude (rk, fam), max(least(1.0, (fam - rk + 1) * p)) over (partition by {family} order by rk rows unbounded preceding) as p_holm from ranked)"""


def rounded(columns: str, *values: str) -> str:
    return ", ".join([columns, *(f"round({v}, 9) as {v}" for v in values)])


GAP = f"""with {RUNS}, {paired("select model, prompt_style, mode, mode_order, item_id, e.em as a, z.em as b from (from long where language = 'en') e join (from long where language = 'az') z using (model, prompt_style, mode, mode_order, item_id)", 'model, prompt_style, mode, mode_order')}, {with_holm('tested', 'model, prompt_style, mode_order')}"""


def model_pairs(where: str) -> str:
    return f"""with {RUNS}, {paired(f"select x.model as model_a, y.model as model_b, prompt_style, mode, mode_order, x.em as a, y.em as b from (from long where {where}) x join (from long where {where}) y using (language, prompt_style, mode, mode_order, item_id) where x.model < y.model", 'model_a, model_b, prompt_style, mode, mode_order')}, {with_holm('tested', 'model_a, model_b, prompt_style, mode_order')}
select {rounded('model_a, model_b, prompt_style, mode, n, discordant, net', 'mean_a', 'mean_b', 'diff', 'p', 'p_holm')} from corrected"""


LINES = "list_filter(string_split_regex(raw_response, '[\\r\\n]'), lambda l: trim(l) <> '')"
RATES = f"""{RUNS},
broken as (select * replace (case when model = 'm1' and prompt_style = 'plain' and item_id % 2 = 0 then trim(prefix) || chr(10) || 'x' else raw_response end as raw_response) from scores),
rates as (
  select {RUN}, count(*) as n, avg((trim(raw_response) = '')::int) as empty_rate, avg((len({LINES}) >= 2 and contains(prefix, trim({LINES}[1])))::int) as example_echo_rate,
    avg((length(question) >= 12 and raw_response <> '' and contains(raw_response, question))::int) as question_echo_rate,
    (count(*) filter (em_strict = 0))::bigint as wrong,
    coalesce(avg((regexp_matches(gold, '[0-9a-zəğışçöüA-ZƏĞIŞÇÖÜİ]') and contains(lower(regexp_replace(raw_response, '[^0-9a-zəğışçöüA-ZƏĞIŞÇÖÜİ]', '', 'g')), lower(regexp_replace(gold, '[^0-9a-zəğışçöüA-ZƏĞIŞÇÖÜİ]', '', 'g'))))::int) filter (em_strict = 0), 0.0) as recoverable_rate
  from broken group by {RUN})"""

VOTES = """votes as (
  select event_type as model, user_id as item_id, substr('ABCD', (max(event_id) % 4 + 1)::int, 1) as letter, substr('ABCD', (user_id % 4 + 1)::int, 1) as key
  from events group by event_type, user_id)"""


def _case(x: str, table: dict[str, str]) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def aliases(word: str) -> str:
    """The ordered forms of a one-word answer that is a column."""
    v = f"regexp_extract(lower({word}), '.*([{text.VOWELS}])', 1)"
    a, i = f"(case when {v} in ('a', 'ı', 'o', 'u') then 'a' else 'ə' end)", f"coalesce({_case(v, morphology.HARMONY)}, 'i')"
    final = f"regexp_matches(lower({word}), '[{text.VOWELS}]$')"
    count = f"(length({word}) - length(translate(lower({word}), '{text.VOWELS}', '')))"
    end = f"right({word}, 1)"
    soft = f"(case when {count} >= 2 and {end} in ('q', 'k', 'Q', 'K') then left({word}, length({word}) - 1) || {_case(end, {'q': 'ğ', 'k': 'y', 'Q': 'Ğ', 'K': 'Y'})} else {word} end)"
    w = word
    vowel = f"[{w}||'d'||{i}||'r', {w}||'d'||{a}, {w}||'nd'||{a}, {w}||'d'||{a}||'n', {w}||'nd'||{a}||'n', {w}||'y'||{a}, {w}||'n'||{i}||'n', {w}||'n'||{i}, {w}||'s'||{i}, {w}||'l'||{a}||'r']"
    cons = f"[{w}||'d'||{i}||'r', {w}||'d'||{a}, {w}||'d'||{a}||'n', {soft}||{a}, {w}||{a}, {soft}||{i}||'n', {w}||{i}||'n', {soft}||{i}, {w}||{i}, {w}||'l'||{a}||'r']"
    return f"(case when {final} then {vowel} else {cons} end)"


ORACLES: dict[str, str] = {f"norm_{m.name}": f"select doc_id, md5({norm('text', m)}) as norm_md5 from documents" for m in MODES}
ORACLES |= {
    "token_f1_docs": f"""with pairs as (select d.doc_id, {tokens('d.text', text.STRICT)} as a, {tokens('b.text', text.STRICT)} as b from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))
select doc_id, round({f1('a', 'b')}, 9) as f1 from pairs""",
    "mode_decomposition": f"""with {RUNS}, t as (select {RUN}, count(*) as n, avg(em_strict) as em_strict, avg(em_morph) as em_morph, avg(em_lenient) as em_lenient, avg(em_translit) as em_translit from scores group by {RUN})
select {rounded(RUN + ', n', 'em_strict', 'em_morph', 'em_lenient', 'em_translit')}, round(em_morph - em_strict, 9) as morph_gain, round(em_lenient - em_morph, 9) as lenient_gain, round(em_translit - em_lenient, 9) as translit_gain from t""",
    "score_best_gold": f"with {RUNS} select {RUN}, item_id, em_strict, em_morph, em_lenient, em_translit, round(f1_strict, 9) as f1_strict, round(f1_translit, 9) as f1_translit from scores",
    "extract_answer_runs": f"with {RUNS} select {RUN}, item_id, prediction from scores",
    "classify_errors": f"""with {RUNS}, c as (select *, case when prediction = '' then 'boş cavab' when em_strict = 1 then '' when em_morph = 1 then 'morfologiya' when em_lenient = 1 then 'diakritika'
  when em_translit = 1 then 'yazı sistemi' when regexp_matches(prediction, '[\\x{{0400}}-\\x{{04FF}}]') then 'kiril, zəncir bərpa etmir' when f1_strict > 0 then 'qismən üst-üstə düşmə' else '' end as error from scores)
select {RUN}, error, count(*) as n from c group by {RUN}, error""",
    "script_share": f"""with {RUNS} select {RUN}, count(*) as n, (count(*) filter (regexp_matches(prediction, '[\\x{{0400}}-\\x{{04FF}}]')))::bigint as cyrillic from scores group by {RUN}""",
    "out_of_script_docs": """with c as (select doc_id, list_sort(list_distinct(list_filter(string_split(text, ''), lambda x: regexp_matches(x, '\\p{L}') and not regexp_matches(x, '[abcçdeəfgğhxıijkqlmnoöprsştuüvyzABCÇDEƏFGĞHXIJKQLMNOÖPRSŞTUÜVYZİ]')))) as l from documents)
select doc_id, array_to_string(l, '') as letters from c""",
    "mcq_suspects": f"""with {VOTES} select item_id, count(*) as votes, min(letter) as letter, min(key) as key from votes group by item_id having count(*) >= 3 and min(letter) = max(letter) and min(letter) <> min(key)""",
    "chance_agreement": f"with {VOTES} select count(distinct model)::bigint as models, count(distinct item_id)::bigint as items, round(count(distinct item_id) * 3 * pow(0.25, count(distinct model)), 9) as expected from votes",
    "majority_baseline": f"""with {ITEMS}, g as (select 'az' as language, {norm('answer', text.STRICT)} as g from items union all select 'en', {norm('answer_en', text.STRICT)} from items), c as (select language, g, count(*) as k from g group by all)
select language, sum(k)::bigint as n, round(max(k) / sum(k), 9) as majority from c group by language""",
    "dataset_stats": """select lang, count(*) as n, count(distinct text)::bigint as distinct_texts, count(distinct source)::bigint as sources, round(avg(len(list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> ''))), 9) as mean_words, max(len(list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '')))::bigint as max_words from documents group by lang""",
    "breakdown_pivot": f"""with {RUNS} select model, language, {', '.join(f'round(avg(em_strict) filter (category = {k}), 9) as c{k}' for k in range(7))} from scores group by model, language""",
    "provenance_pivot": f"""with {RUNS} select model, language, {', '.join(f'round(avg(em_strict) filter (provenance = {k}), 9) as p{k}' for k in range(3))} from scores group by model, language""",
    "coverage_partition": f"""with {RUNS}, kept as (select * from runs where not (model = 'm3' and item_id % 8 = 0)) select {RUN}, count(distinct item_id)::bigint as shared, (select count(*) from items)::bigint as total, count(distinct item_id) >= 0.9 * (select count(*) from items) as complete from kept group by {RUN}""",
    "missing_answers": f"""with {RUNS}, kept as (select * from runs where not (model = 'm3' and item_id % 8 = 0)), seen as (select distinct {RUN} from kept) select c.{RUN.replace(', ', ', c.')}, i.item_id from seen c cross join items i anti join kept k on (k.model = c.model and k.language = c.language and k.prompt_style = c.prompt_style and k.item_id = i.item_id)""",
    "gate_rates": f"with {RATES} select {rounded(RUN + ', n, wrong', 'empty_rate', 'example_echo_rate', 'question_echo_rate', 'recoverable_rate')}, case when empty_rate > 0.2 then 'empty' when example_echo_rate > 0.2 then 'example echo' when question_echo_rate > 0.2 then 'question echo' when recoverable_rate > 0.3 then 'extraction' end as failed_gate from rates",
    "gate_funnel": f"""with {RATES}, t as (select r.*, (select count(distinct item_id) from runs u where (u.model, u.language, u.prompt_style) = (r.model, r.language, r.prompt_style)) >= 0.9 * (select count(*) from items) as c, empty_rate <= 0.2 as e, example_echo_rate <= 0.2 as x, question_echo_rate <= 0.2 as q, recoverable_rate <= 0.3 as y from rates r)
select count(*) as runs, count(*) filter (c) as covered, count(*) filter (c and e) as not_empty, count(*) filter (c and e and x) as no_example_echo, count(*) filter (c and e and x and q) as no_question_echo, count(*) filter (c and e and x and q and y) as extractable from t""",
    "rq1_gap": f"{GAP} select {rounded('model, prompt_style, mode, n, discordant, net', 'mean_a', 'mean_b', 'diff', 'p', 'p_holm')} from corrected",
    "rq2_pairs": model_pairs("language = 'az'"),
    "control_gap": model_pairs("language = 'az' and item_id % 7 in (4, 6)"),
    "gap_closed": f"{GAP}, s as (select *, max(diff) filter (mode = 'strict') over (partition by model, prompt_style) as d0 from corrected) select model, prompt_style, mode, round(case when abs(d0) >= 1e-9 then (d0 - diff) / d0 end, 9) + 0.0 as closed from s",
    "gap_floor_marks": f"""with {RUNS} select model, language, round(avg(em_strict), 9) as em, case when avg(em_strict) < 0.05 then '*' when avg(em_strict) < 0.1 then '+' else '' end as mark from scores where item_id % 3 = 2 group by model, language""",
    "excess_damage": f"""with {RUNS}, pairs as (select * from (values {', '.join(str(p) for p in syn.PAIRS)}) v(label, base, tuned)),
four as (select label, b.prompt_style, b.item_id, b.em_strict - t.em_strict as az, be.em_strict - te.em_strict as en, b.em_translit - t.em_translit as tr, regexp_matches(t.prediction, '[\\x{{0400}}-\\x{{04FF}}]')::int as cy
  from pairs join scores b on b.model = base and b.language = 'az' join scores t on t.model = tuned and t.language = 'az' and t.item_id = b.item_id and t.prompt_style = b.prompt_style
  join scores be on be.model = base and be.language = 'en' and be.item_id = b.item_id and be.prompt_style = b.prompt_style join scores te on te.model = tuned and te.language = 'en' and te.item_id = b.item_id and te.prompt_style = b.prompt_style),
s as (select label, prompt_style, count(*) as n, avg(az) as az_loss, avg(en) as en_loss, avg(az - en) as excess, 1.96 * stddev_samp(az - en) / sqrt(count(*)) as half, avg(tr) as translit_loss, avg(cy) as cyrillic_share from four group by all),
z as (select *, excess - half as low, excess + half as high from s)
select {rounded('label, prompt_style, n', 'az_loss', 'en_loss', 'excess', 'translit_loss', 'cyrillic_share', 'low', 'high')}, case when low > 0 and az_loss > 0 then 'damaged' when low > 0 then 'gained less' when high < 0 and az_loss > 0 then 'lost less' when high < 0 then 'spared' else 'no difference' end as verdict from z""",
    "composition_subsets": f"""with {RUNS}, big as (select category from (select category, count(*) as k from items group by 1) order by k desc, category limit 1),
w as (select model, prompt_style, item_id, category, max(em_strict) filter (language = 'en') - max(em_strict) filter (language = 'az') as d from scores group by all),
f as (select *, category <> (select category from big) as a, category in (4, 6) as b from w),
e as (select model, d, 'all' as subset from f union all select model, d, 'minus largest' from f where a union all select model, d, 'control' from f where b union all select model, d, 'both' from f where a and b),
g as (select model, subset, count(*) as n, avg(d) as gap from e group by all) select subset, sum(n)::bigint as n, round(avg(gap), 9) as mean_gap from g group by subset""",
    "bootstrap_hash": f"""with {RUNS}, v as (select model, language, list(em_strict order by item_id) as x from scores where prompt_style = 'default' group by all),
r as (select model, language, x, unnest(range(0, 200)) as r from v),
d as (select model, language, len(x) as n, list_avg(x) as mean, list_avg(list_transform(range(0, len(x)), lambda i: x[({uniform('0', 'r', 'i')} % len(x)) + 1])) as m from r)
select model, language, n, round(mean, 9) as mean, round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high from d group by model, language, n, mean""",
    "exact_permutation": """with v as (select row_number() over (order by n_nationkey) - 1 as i, (n_nationkey * 37 % 11)::double as x, (n_nationkey % 3 = 0)::int as g from nation),
m as (select unnest(range(0, (1 << (select count(*) from v)::int)))::bigint as m), k as (select sum(g) as k, count(*) as n, sum(x) as t, sum(x * g) as s from v),
s as (select m, sum(x * ((m >> i::int) & 1)) as inside from m cross join v where bit_count(m) = (select k from k) group by m),
o as (select inside / k - (t - inside) / (n - k) as st, s / k - (t - s) / (n - k) as ob from s cross join k)
select round(ob, 9) as observed, round((count(*) filter (abs(st) >= abs(ob) - 1e-9)) / count(*), 9) as p, count(*) as arrangements from o group by ob""",
    "kappa": """with b as (select d.lang, l.quality as a, l.toxic as b from labels l join documents d using (doc_id)), t as (select lang, count(*) as n, avg((a = b)::int) as po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) as pe from b group by lang)
select lang, n, round(po, 9) as agreement, round((po - pe) / (1 - pe), 9) as kappa from t""",
    "null_shuffle_hash": f"""with {VOTES}, r as (select *, unnest(range(0, 20)) as round from votes),
a as (select round, model, letter, row_number() over (partition by round, model order by {uniform('0', 'round', 'model', 'item_id')}, item_id) as k from r),
b as (select round, model, item_id, key, row_number() over (partition by round, model order by item_id) as k from r),
e as (select round, item_id, count(*) as n, min(letter) as x, max(letter) as y, min(key) as key from b join a using (round, model, k) group by round, item_id)
select round::int as round, (count(*) filter (n >= 2 and x = y and x <> key))::bigint as unanimous_wrong from e group by round""",
    "key_balance_chi2": f"with {VOTES}, c as (select letter, count(*) as n from votes group by letter) select letter, n, round(n / sum(n) over (), 9) as share, round(sum(n * n) over () * count(*) over () / sum(n) over () - sum(n) over (), 9) as chi_square from c",
    "stratified_sample": f"""with u as (select doc_id, lang, {uniform('0', 'doc_id')} as u from documents), s as (select lang, count(*) as n, greatest(1, round_even(100 * count(*)::double / (select count(*) from documents), 0)::int) as quota from u group by lang),
r as (select u.*, quota, row_number() over (partition by lang order by u, doc_id) as k from u join s using (lang)) select doc_id, lang from r where k <= quota order by u, doc_id limit 100""",
    "error_sample": f"""with {RUNS}, w as (select item_id, category, {uniform('0', 'item_id')} as u from scores where em_strict = 0 and model = 'm1' and language = 'az' and prompt_style = 'default'),
r as (select *, row_number() over (partition by category order by u, item_id) <= greatest(1, floor(12 / (select count(distinct category) from w))) as early from w) select item_id, category from r order by early desc, u, item_id limit 12""",
    "quota_topk": "select p_partkey, p_brand, rank from (select *, (row_number() over (partition by p_brand order by p_retailprice desc, p_partkey))::int as rank from part) where rank <= 3",
    "round_robin": "select p_partkey, p_brand, ((row_number() over (partition by p_brand order by p_partkey) - 1) % 4)::int as turn from part",
    "leak_check": f"""with t as (select item_id, ' ' || {norm('text', text.STRICT)} || ' ' as n from (select item_id, array_to_string(string_split(text, ' ')[1:8], ' ') as text from benchmark)), d as (select doc_id, ' ' || {norm('text', text.STRICT)} || ' ' as n from documents) select doc_id, item_id from d join t on contains(d.n, t.n) and t.n <> '  '""",
    "single_valued_subjects": "select l_partkey, min(l_suppkey) as l_suppkey from lineitem group by l_partkey having min(l_suppkey) = max(l_suppkey)",
    "inflect_aliases": f"""with w as (select item_id, unnest(['a', 'b']) as which, unnest([string_split(text, ' ')[1], string_split(text, ' ')[2]]) as word0 from benchmark), x as (select item_id, which, regexp_replace(word0, '[^A-Za-zÀ-ÿ]', '', 'g') as word from w), a as (select *, {aliases('word')} as forms from x),
k as (select item_id, which, word, list_filter(forms, lambda f, i: list_position(forms, f) = i and f <> word) as forms from a) select item_id, which, word, array_to_string(forms, ',') as forms from k""",
    "ordinal_suffix": f"""with n as (select o_orderkey::varchar as n from orders) select n, case when right(n, 1) <> '0' then {_case('right(n, 1)', morphology.DIGIT_ORDINALS)} when length(n) >= 2 and substr(n, length(n) - 1, 1) <> '0' then {_case('substr(n, length(n) - 1, 1)', morphology.TENS_ORDINALS)} when length(n) >= 3 and substr(n, length(n) - 2, 1) <> '0' then 'cü' else 'ci' end as suffix from n""",
    "primes": """with n as (select distinct p_partkey as n from part where p_partkey >= 2), d as (select unnest(range(2, (select sqrt(max(n))::bigint + 2 from n))) as d), p as (select n from n where not exists (select 1 from d where d.d < n.n and n.n % d.d = 0)) select n, (row_number() over (order by n))::int as place, lead(n) over (order by n) as next_prime from p""",
    "usage_cost": """with p as (select * from (values ('click', 3.0, 15.0), ('view', 0.5, 1.5), ('error', 0.1, 0.4)) v(event_type, price_in, price_out)), u as (select event_type, count(*) as calls, sum(event_id % 50)::bigint as input_tokens, sum(event_id % 7)::bigint as output_tokens, (count(*) filter (event_id % 11 = 0))::bigint as failures from events group by 1)
select event_type, calls, input_tokens, output_tokens, failures, round((input_tokens * price_in + output_tokens * price_out) / 1e6, 9) as usd from u left join p using (event_type)""",
    "resume_pending": "select event_id from events where event_id not in (select event_id from events where event_id % 3 = 0)",
    "stream_append_scores": f"with {ITEMS} select item_id, md5(answer) as response from items",
    "duplicate_questions": f"""with q as (select doc_id, {norm('text', text.STRICT)} as n from documents) select doc_id, first from (select doc_id, n, min(doc_id) over (partition by n) as first from q) where doc_id <> first and n <> ''""",
}

VALIDATE = f"""with rows as (select 'az-' || lpad((doc_id - (doc_id % 50 = 7)::int)::varchar, 4, '0') as id, doc_id as line, array_to_string(string_split_regex(text, '[ \\n]+')[1:6], ' ') || case when doc_id % 4 = 0 then '?' else '' end as question_az,
  lang as category, case when doc_id % 9 = 0 then '' else 'x' end as answer_en, string_split_regex(text, '[ \\n]+')[case when doc_id % 10 = 0 then 2 else 9 end] as answer from documents),
n as (select *, {norm('question_az', text.STRICT)} as nq, {norm('answer', text.STRICT)} as na from rows),
i as (
  select id, line, 'error' as severity, 'answer_en' as field, 'missing or blank' as message from n where answer_en = ''
  union all select id, line, 'error', 'answer', 'missing or blank' from n where answer is null or answer = ''
  union all select id, line, 'error', 'question_az', 'missing or blank' from n where trim(question_az) = ''
  union all select id, line, 'error', 'category', 'unknown value' from n
  union all select id, line, 'warning', 'question_az', 'no final mark' from n where trim(question_az) <> '' and not regexp_matches(question_az, '[?.!:]\\s*$')
  union all select id, line, 'warning', 'answer', 'occurs in the question' from n where na <> '' and contains(' ' || nq || ' ', ' ' || na || ' ')
  union all select id, line, 'warning', 'verified_by', 'not verified by a human' from n
  union all select id, line, 'error', 'id', 'duplicate id' from (select *, row_number() over (partition by id order by line) as k from n) where k > 1
  union all select id, line, 'warning', 'question_az', 'duplicate question' from (select *, row_number() over (partition by nq order by line) as k from n) where k > 1 and nq <> '')
select * from i"""
ORACLES["validate_items"] = VALIDATE

FORMULAS = {
    "polygon_angle_sum": "(a - 2) * 180", "polygon_diagonals": "a * (a - 3) // 2", "divisor_count": "len(list_filter(range(1, a + 1), lambda d: a % d = 0))",
    "sum_first_n": "a * (a + 1) // 2", "gcd": "gcd(a, b)", "lcm": "lcm(a, b)", "factorial": "factorial((a % 13)::int)", "perfect_square_root": "a", "remainder": "a % b",
    "power": "pow(a % 10, b % 7)", "digit_sum": "list_sum(list_transform(string_split(a::varchar, ''), lambda x: x::bigint))",
    "distinct_prime_factors": "len(list_filter(range(2, a + 1), lambda p: a % p = 0 and len(list_filter(range(2, p), lambda d: p % d = 0)) = 0))",
    "triangle_third_angle": "180 - a - b", "percent_of": "a * b // 100", "arithmetic_term": "a + (b - 1) * 7", "hours_to_seconds": "a * 3600", "sum_range": "(a + b) * (b - a + 1) // 2", "binary_to_decimal": "a",
}
ORACLES["math_items"] = f"""with p as (select distinct p_partkey % 40 + 3 as a, p_partkey % 50 + 43 as b from part),
e as ({' union all '.join(f"select '{k}' as family, a, b, ({v})::bigint as answer from p" for k, v in FORMULAS.items())})
select * from e where not contains(a::varchar || '|' || b::varchar, answer::varchar)"""


def boot(source: str, group: str, value: str, name: str, resamples: int = 1000) -> str:
    """name: low and high of the percentile bootstrap of a mean by group, drawn by md5 in the order of item_id."""
    return f"""{name}_v as (select {group}, list({value} order by item_id) as x from {source} group by all), {name}_r as (select *, unnest(range(0, {resamples})) as r from {name}_v),
{name}_m as (select {group}, list_avg(list_transform(range(0, len(x)), lambda i: x[({uniform('0', 'r', 'i')} % len(x)) + 1])) as m from {name}_r),
{name} as (select {group}, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from {name}_m group by all)"""


GAPS = """gaps as (select model, prompt_style, item_id, e.em_strict as a, z.em_strict as b, e.em_strict - z.em_strict as d from (from scores where language = 'en') e join (from scores where language = 'az') z using (model, prompt_style, item_id))"""
PAIR_GAPS = """gaps as (select x.model as model_a, y.model as model_b, prompt_style, item_id, x.em_strict as a, y.em_strict as b, x.em_strict - y.em_strict as d from (from scores where language = 'az') x join (from scores where language = 'az') y using (prompt_style, item_id) where x.model < y.model)"""
COMPARED = "n, discordant, net"
PAIRS_SQL = f"pairs as (select * from (values {', '.join(str(p) for p in syn.PAIRS)}) v(label, base, tuned))"
CHOICES = f"""choices as (
  select model, item_id, (case when item_id % 4 = (item_id % 4 + u % 2) then 1.0 else 0.0 end)::double as chosen
  from (select item_id, m.model, {uniform('item_id', 'm.model', "'letter'")} as u from items cross join (select unnest({list(syn.MODELS)}) as model) m)),
written as (select model, item_id, {', '.join(f'em_{m.name}' for m in MODES)} from scores where language = 'az' and prompt_style = 'default')"""


def intervals(gaps: str, group: str) -> str:
    return f"""with {RUNS}, {gaps}, {paired('select * from gaps', group)}, {boot('gaps', group, 'd', 'ci')}
select {rounded(group + ', ' + COMPARED, 'mean_a', 'mean_b', 'diff', 'p', 'low', 'high')} from tested join ci using ({group})"""


FOUR = " union all ".join(
    f"select label, b.prompt_style, '{m.name}' as mode, {i} as mode_order, '{g}' as language, b.item_id, b.em_{m.name} as a, t.em_{m.name} as b, b.em_{m.name} - t.em_{m.name} as d from pairs join scores b on b.model = base and b.language = '{g}' join scores t on t.model = tuned and t.language = '{g}' and t.item_id = b.item_id and t.prompt_style = b.prompt_style"
    for i, m in enumerate(MODES) for g in ("az", "en")
)
LETTERS_END = "A-Za-zƏəĞğİıÖöŞşÇçÜü"
ORACLES |= {
    "main_table": f"""with {RUNS}, {boot('scores', RUN, 'em_strict', 'e')}, {boot('scores', RUN, 'f1_strict', 'f')},
t as (select {RUN}, count(*) as n, avg(em_strict) as em, avg(f1_strict) as f1 from scores group by {RUN}),
g as (select {RUN}, {norm('gold', text.STRICT)} as g, count(*) as k from scores group by all), m as (select {RUN}, max(k) / sum(k) as baseline from g group by {RUN})
select {RUN}, t.n, round(em, 9) as em, round(e.low, 9) as em_low, round(e.high, 9) as em_high, round(f1, 9) as f1, round(f.low, 9) as f1_low, round(f.high, 9) as f1_high, round(baseline, 9) as baseline from t join e using ({RUN}) join f using ({RUN}) join m using ({RUN})""",
    "rq1_intervals": intervals(GAPS, "model, prompt_style"),
    "rq2_intervals": intervals(PAIR_GAPS, "model_a, model_b, prompt_style"),
    "confirmatory_table": f"""with {RUNS}, {PAIRS_SQL}, gaps as ({FOUR}), {paired('select * from gaps', 'label, prompt_style, mode, mode_order, language')}, {with_holm('tested', 'label, prompt_style, language, mode_order')}, {boot('gaps', 'label, prompt_style, mode, language', 'd', 'ci')}
select {rounded('label, prompt_style, mode, language, n, discordant, net', 'mean_a', 'mean_b', 'diff', 'p', 'p_holm', 'low', 'high')}, p_holm < 0.05 as significant from corrected join ci using (label, prompt_style, mode, language)""",
    "prompt_verdict": f"""with {RATES}, {GAPS}, {boot('gaps', 'model, prompt_style', 'd', 'ci')}, ok as (select model, prompt_style from rates group by all having count(distinct language) = 2 and max(empty_rate) <= 0.2)
select model, count(*) as styles, case when count(*) < 2 then false else bool_and(low > 0) end as holds from ci join ok using (model, prompt_style) group by model""",
    "pair_gates": f"""with {RATES}, {PAIRS_SQL}, g as (select *, case when example_echo_rate > 0.2 then 'example echo' when question_echo_rate > 0.2 then 'question echo' when recoverable_rate > 0.3 then 'extraction' end as gate from rates)
select label, prompt_style, string_agg(distinct model || ' ' || language || ' ' || prompt_style || ' ' || gate, ', ' order by model || ' ' || language || ' ' || prompt_style || ' ' || gate) as failures from g join pairs on model in (base, tuned) where gate is not null group by label, prompt_style""",
    "error_shares": "",
    "format_contrast": f"""with {RUNS}, {CHOICES}, gaps as ({' union all '.join(f"select model, '{m.name}' as mode, item_id, chosen as a, em_{m.name} as b, chosen - em_{m.name} as d from choices join written using (model, item_id)" for m in MODES)}), {paired('select * from gaps', 'model, mode')}, {boot('gaps', 'model, mode', 'd', 'ci')}
select {rounded('model, mode, ' + COMPARED, 'mean_a', 'mean_b', 'diff', 'p', 'low', 'high')} from tested join ci using (model, mode)""",
    "retention": f"""with {RUNS}, {CHOICES}, kept as ({' union all '.join(f"select model, '{m.name}' as mode, item_id, em_{m.name} as d from choices join written using (model, item_id) where chosen = 1" for m in (text.STRICT, MODES[-1]))}), {boot('kept', 'model, mode', 'd', 'ci')}
select model, mode, count(*) as n, round(avg(d), 9) as kept, round(any_value(low), 9) as low, round(any_value(high), 9) as high from kept join ci using (model, mode) group by model, mode""",
    "mcq_letter": f"""with t as (select *, regexp_replace(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)), '^\\s*(?:cavab|answer)\\s*[:.]\\s*', '', 'i') as s from conversations),
l as (select *, regexp_extract(s, '^[\\s:.\\-*_`"''(\\[]*([ABCD])(?:[^{LETTERS_END}]|$)', 1) as first, regexp_extract(coalesce(text, ''), '(?i:cavab|answer)\\s*[:.]\\s*[*_`"''(\\[]*((?i)[ABCD])(?:[^{LETTERS_END}]|$)', 1) as later from t)
select conv_id, turn, role, case when first <> '' then first else later end as letter, md5(text) as text_md5 from l""",
    "gold_answers": f"""with {ITEMS} select item_id, array_to_string(list_concat([answer], aliases), '|') as golds_az, array_to_string(list_concat([question_en], case when len(list_filter(string_split_regex(question_en, '\\s+'), lambda w: w <> '')) > 1 then list_filter(string_split_regex(question_en, '\\s+'), lambda w: w <> '') else [] end), '|') as golds_en from items""",
    "answer_present": f"""with {RUNS}, f as (select {RUN}, item_id, lower(regexp_replace(raw_response, '[^0-9a-zəğışçöüA-ZƏĞIŞÇÖÜİ]', '', 'g')) as r, lower(regexp_replace(gold, '[^0-9a-zəğışçöüA-ZƏĞIŞÇÖÜİ]', '', 'g')) as g from runs) select {RUN}, item_id, g <> '' and contains(r, g) as present from f""",
    "agreement_by_stratum": """with b as (select d.source, l.quality as a, l.toxic as b from labels l join documents d using (doc_id)), t as (select source, count(*) as n, count(*) filter (a = b) / count(*) as po, (sum(a) * sum(b) + (count(*) - sum(a)) * (count(*) - sum(b))) / (count(*) * count(*)) as pe from b group by source), k as (select *, case when pe = 1 then 'NaN'::double else (po - pe) / (1 - pe) end as kappa from t)
select source, n, round(po, 9) as agreement, round(kappa, 9) as kappa, case when isnan(kappa) then 'undefined' when kappa < 0 then 'poor' when kappa < 0.2 then 'slight' when kappa < 0.4 then 'fair' when kappa < 0.6 then 'moderate' when kappa < 0.8 then 'substantial' else 'almost perfect' end as reading from k""",
    "kappa_bands": "with k as (select o_orderkey, (o_orderkey % 111 - 10) / 100 as kappa from orders) select o_orderkey, kappa, case when kappa < 0 then 'poor' when kappa < 0.2 then 'slight' when kappa < 0.4 then 'fair' when kappa < 0.6 then 'moderate' when kappa < 0.8 then 'substantial' else 'almost perfect' end as reading from k",
    "prompt_texts": f"""with {ITEMS} select item_id, md5('Sual: Misir. Cavab: Qahir' || chr(10) || 'Sual: ' || question_az || chr(10) || 'A) ' || answer || chr(10) || 'B) ' || answer_en || chr(10) || 'C) x' || chr(10) || 'D) y' || chr(10) || 'Cavab:') as prompt_md5, 'Sual: Misir. Cavab: Qahir' || chr(10) || 'Sual: ' as prefix from items""",
}
ORACLES["error_shares"] = f"""with k as ({ORACLES['classify_errors']}) select {RUN}, error, n, round(n / sum(n) over (partition by {RUN}), 9) as share from k"""
ORACLES["bootstrap_hash_full"] = ORACLES["bootstrap_hash"].replace("range(0, 200)", "range(0, 1000)")
ORACLES["null_shuffle_hash_full"] = ORACLES["null_shuffle_hash"].replace("range(0, 20)", "range(0, 1000)")
#: Of the subsets of the nations, how many have each size and sum: nation by nation.
ORACLES["exact_permutation_nations"] = """with recursive v as (select row_number() over (order by n_nationkey) as i, n_nationkey * 37 % 11 as x, n_nationkey % 3 = 0 as g from nation),
t as (select 0::bigint as i, 0 as k, 0 as s, 1::bigint as c
  union all select i, k, s, sum(c)::bigint from (select t.i + 1 as i, t.k + b as k, t.s + b * v.x as s, t.c from t join v on v.i = t.i + 1 cross join (select unnest([0, 1]) as b)) group by i, k, s),
o as (select count(*) as n, count(*) filter (g) as k, sum(x) as total, sum(x) filter (g) as inside from v),
e as (select t.c, t.s / o.k - (o.total - t.s) / (o.n - o.k) as st, o.inside / o.k - (o.total - o.inside) / (o.n - o.k) as ob from t, o where t.i = o.n and t.k = o.k)
select round(ob, 9) as observed, round(sum(c) filter (abs(st) >= abs(ob) - 1e-9) / sum(c), 9) as p, sum(c)::bigint as arrangements from e group by ob"""
ORACLES["leak_check_whole"] = ORACLES["leak_check"].replace("array_to_string(string_split(text, ' ')[1:8], ' ')", "text")
ORACLES["validate_items_whole"] = VALIDATE.replace("array_to_string(string_split_regex(text, '[ \\n]+')[1:6], ' ')", "array_to_string(list_filter(string_split_regex(text, '[ \\n]+'), lambda w, i: doc_id % 10 = 0 or i <> 9), ' ')")
