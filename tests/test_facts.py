"""Facts as patterns, reasons, wordings, dense numbers and balanced choices."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qiyas.functions.text import STRICT
from qiyas.operators import curation, facts, numbering
from qiyas.plans import items

URI = "http://www.wikidata.org/entity/"
T = facts.Template("capital", "geography", "country", "capital", (("{subject_gen} paytaxtı hansıdır?", "what is the capital of {subject}?"), ("{subject_loc} paytaxt?", "{subject} has which capital?")), least_links=5)


def graph(spark, extra=()):
    rows = []

    def node(n, az, en, links=9, kind="country", **props):
        s = URI + n
        rows.extend([(s, "kind", kind, None), (s, "links", str(links), None)] + [(s, "label", az, "az")] * (az is not None) + [(s, "label", en, "en")] * (en is not None))
        rows.extend((s, p, v if v.startswith("=") else URI + v, None) for p, vs in props.items() for v in ([vs] if isinstance(vs, str) else vs))

    node("Q1", "Fransa", "France", 20, capital="Q11")
    node("Q2", "Bakı", "baku land", 30, capital="Q12")
    node("Q3", "İki", "Two", capital=["Q11", "Q12"])  # two values, of which one has no label
    node("Q4", "az", "few", 4, capital="Q11")
    node("Q5", "Şəhər", "City", kind="city", capital="Q11")
    node("Q6", "Adsız", None, capital="Q11")
    node("Q7", "Qonşu", "Neighbour", 6, capital="Q13")
    rows.extend([(URI + "Q11", "label", "Paris", "az"), (URI + "Q11", "label", "Paris", "en"), (URI + "Q13", "label", "Roma", "az"), (URI + "Q13", "label", "Rome", "mul"), *extra])
    return spark.createDataFrame(rows, "subject string, property string, object string, lang string").repartition(3)


def found(df):
    return {r.subject.removeprefix(URI): (r.subject_az, r.subject_en, r.answer_az, r.answer_en, r.links) for r in df.collect()}


def test_patterns(spark):
    g = graph(spark)
    assert found(facts.bindings(g, T)) == {"Q1": ("Fransa", "France", "Paris", "Paris", 20)}
    more = found(facts.bindings(g, T, en=("en", "mul")))
    assert set(more) == {"Q1", "Q7"} and more["Q7"][3] == "Rome"
    loose = facts.bindings(g, facts.Template("any", "world", None, "capital", T.wordings, one_value=False, least_links=0), en=("en",))
    assert sorted(r.subject.removeprefix(URI) for r in loose.collect()) == ["Q1", "Q3", "Q4", "Q5"]
    assert set(found(facts.bindings(g, T, en=("en", "mul"), pool=spark.createDataFrame([(URI + "Q7",)], "subject string")))) == {"Q7"}
    assert facts.bindings(g.limit(0), T).count() == 0
    for df in (facts.bindings(g, T), facts.items(facts.candidates(facts.bindings(g, T)), T)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_table_of_a_pattern_is_built_in_the_driver(spark):
    for df in (facts.bindings(graph(spark), T), facts.bindings(graph(spark), T, pool=spark.createDataFrame([(URI + "Q1",)], "subject string"))):
        assert set(found(df)) == {"Q1"}
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_values_without_names(spark):
    t = facts.Template("code", "world", "country", "code", T.wordings, literal=True)
    g = graph(spark, [(URI + "Q1", "code", " +33", None), (URI + "Q2", "code", "994", None), (URI + "Q2", "code", "99", None)])
    assert found(facts.bindings(g, t)) == {"Q1": ("Fransa", "France", "+33", "+33", 20)}


REASONS = {
    "several": [("s", "Ölkə", "Country", "A", "A"), ("s", "Ölkə", "Country", "B", "B")], "label": [("l", "Ölkə (x)", "C", "A", "A")], "list": [("m", "Ölkə", "C", "Qalaların siyahısı", "list")],
    "cyrillic": [("c", "Ölkə", "C", "Хабиби", "Habibi")], "english": [("e", "Ölkə", "C", "Şıx", "Şıx")], "copied": [("f", "Ölkə", "C", "Düz", "Düz")], "zurich": [("z", "Ölkə", "C", "Sürix", "Zürich")],
    "blocked": [("b", "Ölkə", "C", "İran", "Iran")], "example": [("p", "Ölkə", "C", "Qahirə", "Cairo")], "long": [("o", "Ölkə", "C", "bir iki üç dörd", "x")], "equal": [("q", "Roma", "R", "roma!", "R")], "inside": [("i", "Xocalı soyqırımı", "C", "Xocalı rayonu", "K")],
}


def test_reasons(spark):
    rows = [(*r, 1) for of in REASONS.values() for r in of] + [(f"k{i}", f"Ad{i}", f"N{i}", "Çox", "Many", i) for i in range(5)]
    df = spark.createDataFrame(rows, "subject string, subject_az string, subject_en string, answer_az string, answer_en string, links int")
    judged = facts.candidates(df, spark.createDataFrame([("k3",), ("b",)], "subject string"))
    got = {r.subject: r.reason for r in judged.collect()}
    want = dict(zip([of[0][0] for of in REASONS.values()], ["multi_valued", "bad_label", "bad_label", "cyrillic_answer", "en_label_not_english", "en_label_not_english", None, "blocked_answer", "prompt_example", "answer_too_long", "answer_equals_subject", "answer_inside_subject"], strict=True))
    assert got == want | {"k0": "over_quota", "k1": "over_quota", "k2": None, "k3": "reviewed", "k4": None}
    stats = {r.reason: r.n for r in facts.filter_stats(judged).collect()}
    assert stats["kept"] == 3 and stats["multi_valued"] == 2 and sum(stats.values()) == len(rows)


def test_reviewed_addresses(spark):
    raw = spark.createDataFrame([("https://www.wikidata.org/wiki/Q142/",), ("http://www.wikidata.org/entity/Q7",), ("https://example.org/Q9",), (None,)], "source string")
    assert sorted(r.subject for r in facts.reviewed(raw).collect()) == ["Q142", "Q7"]


def test_wordings_take_turns(spark):
    judged = spark.createDataFrame([(f"{URI}Q{i}", name, en, f"Cavab{i}", "A", links, None) for i, (name, en, links) in enumerate([("Fransa", "france", 9), ("Bakı", "Baku", 9), ("Gürcüstan", "georgia", 50), ("{subject_gen} X", "{subject}", 1)])], "subject string, subject_az string, subject_en string, answer_az string, answer_en string, links int, reason string")
    rows = {r.id: r for r in facts.items(judged, T, start=7).collect()}
    assert [rows[f"az-{k:03}"].question_az for k in (7, 8, 9)] == ["Gürcüstanın paytaxtı hansıdır?", "Fransada paytaxt?", "Bakının paytaxtı hansıdır?"]
    assert [rows[f"az-{k:03}"].question_en for k in (7, 8, 10)] == ["What is the capital of georgia?", "France has which capital?", "{subject} has which capital?"]
    assert rows["az-009"].notes == "template=capital;variant=0" and rows["az-009"].source == "https://www.wikidata.org/wiki/Q1" and "Cavab1" not in rows["az-009"].answer_aliases
    assert facts.items(judged, T, most=2).count() == 2
    skew = facts.answer_skew(spark.createDataFrame([("A",), ("a!",), ("b",)], "answer string")).first()
    assert (skew["items"], skew.answers, skew.top_answer, skew.skewed) == (3, 2, "a", True)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_dense_numbers(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(20)]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "v int, k int").repartition(7)
    got = numbering.numbered(df, [F.desc_nulls_last("v"), "k"], "no", 5).collect()
    assert sorted((r.no, r.k) for r in got) == [(5 + i, k) for i, (_, k) in enumerate(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])))]
    turns = Counter(r.turn for r in numbering.turns(df, ["k"], 3).collect())
    assert n == 0 or max(turns.values()) - min(turns.get(t, 0) for t in range(3)) <= 1
    assert "SinglePartition" not in numbering.numbered(df, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_all_defects_and_balanced_places(spark):
    q = "Hansı şəhər Fransanın paytaxtıdır?"
    four = ["Roma", "Paris", "Oslo", "Bonn"]
    cases = {
        "bad_key": (q + "1", four, "E"), "choice_count": (q + "2", four[:3], "A"), "empty_choice": (q + "3", ["", *four[1:]], "B"), "duplicate_choice": (q + "4", ["Paris", *four[1:]], "B"),
        "comma_split": (q + "5", ["-0,", *four[1:]], "B"), "broken_decimal": (q + " 22, 4 l", four, "B"), "list_reference": ("AŞAĞIDAKILARDAN hansı paytaxtdır?", four, "B"), "too_short": ("Paytaxt?", four, "A"),
        "answer_in_question": ("Paris hansı ölkənin paytaxtıdır, deyin?", four, "B"), "meta_answer": (q + "6", ["Heç biri", *four[1:]], "A"), "long_answer": (q + "7", ["a b c d e f g", *four[1:]], "A"),
        "enum_answer": (q + "8", ["Ic. IIa. IIIb", *four[1:]], "A"), "formula_answer": (q + "9", ["-1/81", *four[1:]], "A"),
    }
    rows = [(i, c, l, k, "s", "test") for i, (c, l, k) in enumerate(cases.values())] + [(100 + i, f"{q} {i}", [f" {x} " for x in four], "ABCD"[i % 3], "s", "test") for i in range(9)]
    rows += [(200, q + " 0", four, "A", "s", "test"), (201, q + " birinci", ["60 km/saat", "2", "3", "5kq"], "D", "s", "test"), (202, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "item_id int, question string, choices array<string>, letter string, subject string, split string")
    judged = curation.choice_defects(df)
    got = {r.item_id: r.issues for r in judged.collect()}
    assert [got[i] for i in range(len(cases))] == [[k] for k in cases] and got[200] == ["duplicate_question"] and got[201] == [] and got[202] == ["bad_key", "choice_count", "too_short"]
    drafts = {r.item_id: r for r in curation.short_answers(judged, "src", "cite", start=3).collect()}
    assert sorted(drafts) == [*range(100, 109), 201]
    for n, (k, r) in enumerate(sorted(drafts.items())):
        assert r.id == f"tumlu-az-{3 + n}" and r.answer_letter == "ABCD"[n % 4] and r.choices[n % 4] == r.answer and len(set(r.choices)) == 4
    assert drafts[201].answer_aliases == ["5 kq"] and drafts[100].answer == "Roma" and STRICT.name == "strict"


@pytest.mark.parametrize("name", ["filter_reasons", "filter_stats", "fact_items", "answer_skew"])
def test_a_pattern_is_not_planned_again_for_each_table(spark, name):
    plan = items.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 6  # a written table a template, and the row of its numbers
