"""Queries about vocabularies, and their SQL. The vocabulary file is that of the public tokenizers, if they are installed."""

from __future__ import annotations

import importlib.util

from pyspark.sql import functions as F

from qiyas.operators import fertility
from qiyas.plans.catalogue import Query, rounded, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RANKS = "byte_bpe_50k.tiktoken"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def added_tokens(spark, sf_dir):
    """Each language's words as a vocabulary, against those of English; and one that no document is in."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.col("lang").alias("name"), F.explode(F.split("text", r"[ \n]+")).alias("piece")).where("piece <> ''")
    langs = docs.select("lang").distinct().where("lang <> 'en'").select(F.col("lang").alias("label"), F.lit("en").alias("base"), F.col("lang").alias("tuned"))
    missing = spark.createDataFrame([("none", "en", "none")], "label string, base string, tuned string")
    return fertility.added(words, langs.unionByName(missing))


ORACLES["added_tokens"] = """with w as (select distinct lang, unnest(string_split_regex(text, '[ \\n]+')) as piece from documents),
v as (select * from w where piece <> ''), e as (select * from v where lang <> 'en' and piece not in (select piece from v where lang = 'en')),
c as (select lang, count(*) filter (length(piece) > 2 and (piece like '<%>' or piece like '[%]')) as special, count(*) as n from e group by lang)
select d.lang as label, coalesce(n - special, 0) as words, coalesce(special, 0) as special, coalesce(n - special, 0) = 0 as controlled
from (select distinct lang from documents where lang <> 'en') d left join c using (lang) union all select 'none', null, null, null"""

if importlib.util.find_spec("public_tokenizers"):
    import public_tokenizers

    @query
    def fertility_by_lang(spark, sf_dir):
        with open(public_tokenizers.path(RANKS), encoding="ascii") as f:  # a file of the driver's installation, as large as a vocabulary
            ranks = fertility.ranks(spark.createDataFrame([(line,) for line in f], "value string"))
        return rounded(fertility.measured(table(spark, sf_dir, "documents"), ranks, "lang"), "per_word")

    _S = "\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
    #: Before the last of several white spaces that a word follows stands a mark, as the engine has no lookahead.
    ORACLES["fertility_by_lang"] = f"""with recursive ranks as (select hex(from_base64(split_part(line, ' ', 1))) as piece, split_part(line, ' ', 2)::bigint as rank from read_csv('{public_tokenizers.path(RANKS)}', header = false, delim = '\\x01', quote = '', columns = {{'line': 'varchar'}})),
cut as (select lang, unnest(regexp_extract_all(regexp_replace(text, '([{_S}])([{_S}][^{_S}])', '\\1\ue000\\2', 'g'), '''(?:[sdmt]|ll|ve|re)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_S}\\p{{L}}\\p{{N}}\ue000]+|[{_S}]+')) as word from documents where text is not null),
counts as (select lang, word, count(*) as n from cut group by all),
t as (
  select word, regexp_extract_all(hex(encode(word)), '..') as syms, 0 as step, true as go from (select distinct word from counts)
  union all
  select t.word, case when b.piece is null then t.syms else list_reduce(t.syms, lambda acc, x: case when acc[-1] || x = b.piece then list_append(acc[:-2], b.piece) else list_append(acc, x) end, []::varchar[]) end, step + 1, b.piece is not null
  from t left join (
    select word, arg_min(piece, rank) as piece from (select t.word, syms[i] || syms[i + 1] as piece from t, unnest(range(1, len(syms))) u(i) where go) join ranks using (piece) group by word) b using (word)
  where t.go),
sizes as (select word, len(syms) as pieces from t where not go),
p as (select lang, sum(n * pieces)::bigint as pieces from counts join sizes using (word) group by lang),
w as (select lang, sum(len(list_filter(string_split_regex(text, '[{_S}]+'), lambda x: x <> '')))::bigint as words from documents group by lang)
select lang, pieces, words, round(case when words > 0 then pieces / words else 0 end, 9) as per_word from w join p using (lang)"""
