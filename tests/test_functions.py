"""Literal cases of the text, answer and morphology functions, and brute force of the statistics."""

import itertools
import random
import math

import pytest
from pyspark.sql import functions as F

from qiyas.functions import answers, morphology, text
from qiyas.operators import curation, statistics


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(("raw", "mode", "want"), [
    ("İstanbul, IŞIQ!", text.STRICT, "istanbul ışıq"), ("Şəhərlərdə", text.MORPH, "şəhər"), ("Bakıdan", text.MORPH, "bak"),
    ("Şəhərdə", text.LENIENT, "seher"), ("Париж", text.TRANSLIT, "parij"), ("H₂O", text.STRICT, "h2o"), ("    ", text.STRICT, ""), (None, text.STRICT, ""),
])
def test_normalize(spark, raw, mode, want):
    assert one(spark, text.normalize(F.lit(raw), mode)) == want


def loop_strip(token):
    for _ in range(3):
        for s in sorted(text.SUFFIXES, key=lambda s: -len(s)):
            stem = token[: -len(s)]
            if token.endswith(s) and len(stem) >= 3 and any(c in text.VOWELS for c in stem):
                token = stem
                break
        else:
            return token
    return token


def test_strip_equals_loop(spark):
    words = ["".join(p) for p in itertools.product("bad", "aə", "rl", ["da", "lar", "ın"], ["", "da", "dən", "ı"], ["", "a"])] + ["", "a", "da", "btrda", "evindən", "qapısı"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.strip_suffixes(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: loop_strip(w) for w in words}


@pytest.mark.parametrize(("raw", "want"), [
    ("**Cavab:** Bakı.", "Bakı"), ("<think>x</think>Paris\nizahat", "Paris"), ("<think>never closed", ""), ("The answer is «Rome»", "Rome"), ("", ""), (None, ""),
    ("one two three four five six. seven eight nine ten eleven twelve thirteen", "one two three four five six"), ("Almaniya", "Almaniya"), ("A: x", "x"),
])
def test_extract(spark, raw, want):
    assert one(spark, answers.extract_answer(F.lit(raw).cast("string"))) == want


def test_extract_skips_the_asked_question(spark):
    prompt = F.lit("Sual: a?\nCavab: b\nSual: Fransanın paytaxtı?\nCavab:")
    assert one(spark, answers.extract_answer(F.lit("Sual: Fransanın paytaxtı?\nCavab: Paris"), prompt)) == "Paris"
    assert one(spark, answers.answers_another_question(F.lit("Sual: a?\nCavab: b"), prompt)) is True


@pytest.mark.parametrize(("raw", "want"), [("B", "B"), ("Cavab: **B) x**", "B"), ("Bu sual", ""), ("Sual: x\n\nCavab: C", "C"), ("(d)", ""), ("", "")])
def test_letter(spark, raw, want):
    assert one(spark, answers.letter_of(F.lit(raw))) == want


def test_echoes(spark):
    assert one(spark, answers.echoes_question(F.lit("Fransanın paytaxtı hansıdır?"), F.lit("Fransanın paytaxtı hansıdır?"))) is True
    assert one(spark, answers.echoes_examples(F.lit("H2O\nSual: x"), F.lit("nümunə: H2O"))) is True
    assert one(spark, answers.answer_present(F.lit("it is: BA-KU"), F.lit("Baku"))) is True
    assert one(spark, answers.excel_safe(F.lit("=1+1"))) == "\t=1+1"


@pytest.mark.parametrize(("word", "genitive", "locative"), [("Fransa", "Fransanın", "Fransada"), ("Stadnik", "Stadnikin", "Stadnikdə"), ("otaq", "otağın", "otaqda"), ("Xəzər dənizi", "Xəzər dənizinin", "Xəzər dənizində"), ("Bakı", "Bakının", "Bakıda")])
def test_cases(spark, word, genitive, locative):
    assert one(spark, morphology.genitive(F.lit(word))) == genitive
    assert one(spark, morphology.locative(F.lit(word))) == locative


def test_aliases(spark):
    assert one(spark, morphology.aliases_for(F.lit("1918"))) == ["1918-ci il", "1918-ci ildə", "1918-ci ilin"]
    got = one(spark, morphology.aliases_for(F.lit("Xəzər dənizi")))
    assert "Xəzər dənizində" in got and "Xəzər dənizi" not in got and len(got) <= 24
    assert one(spark, morphology.az_capitalize(F.lit("«ispan"))) == "«İspan"
    assert [one(spark, morphology.ordinal_suffix(F.lit(x))) for x in ("1918", "1920", "1900", "2000", "10", "6")] == ["ci", "ci", "cü", "ci", "cu", "cı"]
    assert one(spark, morphology.equivalence_aliases(F.lit("Saleh Baku"), F.lit("Baku"))) == ["Saleh", "Baku"]


def test_sign_flip_equals_binomial(spark):
    for m, d in ((0, 0), (1, 1), (10, 4), (171, 37), (900, 30)):
        want = 1.0 if d == 0 else min(1.0, 2 * sum(math.comb(m, k) for k in range((m + d) // 2, m + 1)) / 2**m)
        assert one(spark, statistics.sign_flip_exact(F.lit(m), F.lit(d))) == pytest.approx(want, rel=1e-9)


def test_holm(spark):
    ps = [0.04, 0.01, 0.03, 0.5]
    got = statistics.holm(spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "f string, i int, p double"), ["f"], "p", ["i"]).orderBy("i").collect()
    assert [r.p_holm for r in got] == pytest.approx([0.09, 0.04, 0.09, 0.5])


def test_exact_permutation_equals_combinations(spark):
    rows = [(i, float(v), i in (1, 4, 5)) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2])]
    got = statistics.exact_permutation(spark.createDataFrame(rows, "k int, v double, g boolean"), "k", "v", "g").first()
    v = [r[1] for r in rows]
    stat = lambda idx: sum(v[i] for i in idx) / 3 - sum(x for i, x in enumerate(v) if i not in idx) / 4
    every = [stat(c) for c in itertools.combinations(range(7), 3)]
    assert got.observed == pytest.approx(stat((1, 4, 5))) and got.arrangements == 35
    assert got.p == pytest.approx(sum(abs(s) >= abs(stat((1, 4, 5))) - 1e-9 for s in every) / 35)


def test_kappa_undefined(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 1, 1)], "g string, a int, b int")
    assert math.isnan(statistics.cohen_kappa(df, ["g"], "a", "b").first().kappa)


def test_filter_reasons(spark):
    rows = [("s1", "Baku city", "Baku", 5), ("s2", "France", "Paris", 9), ("s2", "France", "Lyon", 8), ("s3", "Spain", "Мадрид", 3), ("s4", "Oslo", "oslo", 1), ("s5", "x", "a b c d", 1), ("s6", "y", "H2O", 1), ("s7", "z (film)", "Rome", 1), ("s8", "Italy", "Rome", 4)]
    df = spark.createDataFrame([*rows, *[(f"t{i}", f"country {i}", "Berlin", i) for i in range(5)]], "subject string, subject_label string, answer string, links int")
    got = {(r.subject, r.answer): r.reason for r in curation.filter_reasons(df, ["h2o"]).collect()}
    assert got["s1", "Baku"] == "answer_inside_subject" and got["s2", "Paris"] == got["s2", "Lyon"] == "multi_valued" and got["s3", "Мадрид"] == "cyrillic_answer"
    assert got["s4", "oslo"] == "answer_equals_subject" and got["s5", "a b c d"] == "answer_too_long" and got["s6", "H2O"] == "blocked_answer" and got["s7", "Rome"] == "bad_label" and got["s8", "Rome"] is None
    assert [got[f"t{i}", "Berlin"] for i in range(5)] == ["over_quota", "over_quota", None, None, None]


def test_choice_defects(spark):
    rows = [(1, "What is the capital city of France?", ["Rome", "Paris", "Oslo", "Bonn"], "B"), (2, "what is the capital city of france?", ["Rome", "Paris", "Oslo", "Bonn"], "B"), (3, "Short?", ["a", "a", "", "3,"], "E"), (4, "Is Paris the capital city of France?", ["Rome", "Paris", "Oslo", "Bonn"], "B")]
    got = {r.item_id: r.issues for r in curation.choice_defects(spark.createDataFrame(rows, "item_id int, question string, choices array<string>, letter string")).collect()}
    assert got == {1: [], 2: ["duplicate_question"], 3: ["bad_key", "empty_choice", "duplicate_choice", "comma_split", "too_short"], 4: ["answer_in_question"]}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: [rng.choice("abc") for _ in range(n)]
    docs = [(i, word(rng.randint(0, 40))) for i in range(60)] + [(100, None), (7, ["a", "b"])]
    needles = [(i, word(n)) for i, n in enumerate((0, 1, 2, 3, 5, 8, 9, 12))] + [(50, docs[3][1]), (51, docs[9][1][:10] + ["x"]), (52, None)]
    of = lambda rows, k: spark.createDataFrame(rows, f"{k} int, tokens array<string>")
    got = [tuple(r) for r in curation.leaks(of(docs, "doc_id"), of(needles, "item_id"), anchor=4).collect()]
    has = lambda d, n: any(d[i : i + len(n)] == n for i in range(len(d) - len(n) + 1))
    assert sorted(got) == sorted({(i, j) for i, d in docs for j, n in needles if d and n and has(d, n)})
    plan = curation.leaks(of(docs, "doc_id"), of(needles, "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert curation.leaks(of(docs, "doc_id"), of(needles, "item_id").limit(0)).count() == 0


def test_suffixes_from_the_end_equal_one_after_another(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcçdeəfğıioöuüxz") for _ in range(rng.randint(1, 6))) + "".join(rng.choice(text.SUFFIXES) for _ in range(rng.randint(0, 5))) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for folded in (False, True):
        token = text.fold_diacritics(F.col("w")) if folded else F.col("w")
        one = token
        for _ in range(text.STRIPS):
            one = F.regexp_replace(one, text.suffix_pattern(folded), "$1")
        assert df.where(one != text.strip_suffixes(token, folded)).count() == 0 < df.where(one != token).count()


def test_inflections_are_small_expressions(spark):
    # copies of a word's expression in each form would fill the driver
    sizes = {f.__name__: len(str(f(F.col("x")))) for f in (morphology.genitive, morphology.locative, morphology.all_forms, morphology.aliases_for)}
    assert max(sizes.values()) < 10_000, sizes
