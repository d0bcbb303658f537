"""People's answers, labels and sheets, and the script study on small rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from qiyas.operators import human, labelling, paired
from qiyas.plans import readers
from qiyas.sources import logs

SCORES = "model string, language string, prompt_style string, item_id int, prediction string, " + ", ".join(f"{k}_{m} double" for m in ("strict", "morph", "lenient", "translit") for k in ("em", "f1"))


def score(model, style, item, em, last=None, said="x", language="az"):
    values = [em, em, em, em if last is None else last]
    return (model, language, style, item, said, *[v for x in values for v in (float(x), float(x))])


def test_people(spark):
    items = spark.createDataFrame([(i, "c" if i < 3 else "d", [f"Bakı{i}", "Baku"]) for i in range(6)], "item_id int, category string, golds array<string>")
    answers = spark.createDataFrame([(0, "bakı0"), (1, "BAKU!"), (2, " "), (3, None), (4, "no"), (99, "Baku")], "item_id int, answer string")
    h = human.human_scores(items, answers)
    t = {r["mode"]: r for r in human.human_table(h, 50).collect()}
    assert set(t) == {"strict", "morph", "lenient", "translit"} and (t["strict"].n, t["strict"].blank, t["strict"].em) == (5, 2, 0.4) and t["strict"].low <= 0.4 <= t["strict"].high
    assert {r.category: (r.n, round(r.em, 3)) for r in human.human_by(h, "category").collect()} == {"c": (3, 0.667), "d": (2, 0)}
    rows = [score("good", "default", i, 1) for i in range(5)] + [score("few", "default", 0, 1)] + [score("bad", "default", i, 0, i == 0) for i in range(6)] + [score("other", "plain", i, 1) for i in range(5)]
    got = {r.name: (r.n, r.em, r.best) for r in human.against_models(h, spark.createDataFrame(rows, SCORES)).collect()}
    assert got == {"good": (5, 1.0, None), "bad": (5, 0.2, None), "human": (5, 0.4, False)}
    assert human.against_models(h.limit(0), spark.createDataFrame(rows, SCORES)).count() == 0
    alone = human.against_models(h, spark.createDataFrame(rows, SCORES).limit(0)).first()
    assert alone.name == "human" and alone.best


def test_script_study(spark):
    rows = [score(m, s, i, m == "b" or (s == "script" and i < 3), 1, "да" if m == "t" and s == "default" else "x") for m in "bt" for s in ("default", "script") for i in range(8) if (m, s, i) != ("t", "script", 7)]
    df = spark.createDataFrame([*rows, score("b", "default", 0, 0, language="en"), score("z", "default", 0, 0)], SCORES)
    four = human.cells(df, "b", "t")
    assert {(r.model, r.prompt_style): (r.n, round(r.em_strict, 3), r.em_last) for r in human.matrix(four).collect()} == {("b", "default"): (7, 1, 1), ("b", "script"): (7, 1, 1), ("t", "default"): (7, 0, 1), ("t", "script"): (7, 0.429, 1)}
    gap = {(r.prompt_style, r["mode"]): r for r in human.gap(four, 50).collect()}
    assert gap["default", "strict"].diff == 1 and gap["default", "strict"].closed == 0 and gap["default", "translit"].closed == 1 and gap["default", "strict"].p == pytest.approx(2 / 128)
    assert len(gap) == 8 and gap["default", "strict"].p_holm == pytest.approx(8 * 2 / 128)
    effect = {(r.model, r["mode"]): r for r in human.script_effect(four, resamples=50).collect()}
    assert effect["t", "strict"].diff == pytest.approx(3 / 7) and effect["b", "strict"].diff == 0 and effect["b", "strict"].p == 1
    assert {(r.model, r.prompt_style): (r.cyrillic, r.latin, r.share) for r in human.script_counts(four).collect()}["t", "default"] == (7, 0, 1)
    assert human.ladder(four, 20).count() == 16
    with pytest.raises(ValueError, match=r"t \[script\]"):
        human.cells(df.where("not (model = 't' and prompt_style = 'script')"), "b", "t")


def test_control_stratum(spark):
    rows = [score(m, "default", i, m == "a", language=g) for m in "abc" for g in ("az", "en") for i in range(12)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(["template=country_capital;variant=1", "x;template=country_currency", "template=person_birthplace", None, "template=country_capitals"] * 2)], "item_id int, notes string")
    ids = labelling.universal(items)
    assert sorted(r.item_id for r in ids.collect()) == [0, 1, 5, 6]
    got = {(r.language, r.model_a, r.model_b, r["mode"]): r for r in paired.control(spark.createDataFrame(rows, SCORES), ids, 50).collect()}
    assert len(got) == 3 * 5 and {k[3] for k in got if k[0] == "en"} == {"strict"} and {r.n for r in got.values()} == {4}
    assert got["az", "a", "b", "strict"].significant and not got["az", "b", "c", "strict"].significant
    keys = items.select(labelling.group_key(F.col("notes"), "template").alias("t"), labelling.group_key(F.col("notes"), "variant").alias("v")).distinct().collect()
    assert ("country_capital", "1") in keys and ("—", "—") in keys and ("country_currency", "—") in keys


def test_second_reader(spark):
    items = spark.createDataFrame([(str(i), f"q{i}", f"a{i}", None, "c", "manual" if i < 3 else "wiki") for i in range(6)], "id string, question_az string, answer string, answer_en string, category string, provenance string")
    answers = spark.createDataFrame([("0", "düzgün", None), ("1", "səhv", " no "), ("3", "düzgün", ""), ("4", "?", "x"), ("9", "qeyri-səlis", "gone")], "id string, label string, comment string")
    rows = labelling.labelled(answers, items)
    assert {r.label: (r.n, r.share) for r in labelling.agreement_labels(rows).collect()} == {"düzgün": (2, 0.5), "səhv": (1, 0.25), "qeyri-səlis": (1, 0.25)}
    assert {r.provenance: (r.n, r.agreement, r.reading) for r in labelling.agreement_summary(rows, "provenance").collect()} == {"manual": (2, 0.5, "slight"), "wiki": (1, 1.0, "undefined"), "?": (1, 0.0, "slight")}
    assert labelling.agreement_summary(rows).first().agreement == 0.5
    assert {(r.first, r.second): r.n for r in labelling.agreement_confusion(rows).collect()}["düzgün", "səhv"] == 1
    assert {tuple(r) for r in labelling.disagreements(rows, items).collect()} == {("1", "səhv", "q1", "a1", "no"), ("9", "qeyri-səlis", None, None, "gone")}
    assert labelling.agreement_labels(rows.limit(0)).count() == 0
    sheet = labelling.agreement_sheet(items, answers.select("id"))
    assert sheet.columns == ["id", "question_az", "answer", "answer_en", "category", "label", "comment"] and sheet.count() == 4 and sheet.where("answer_en <> '' or label <> ''").count() == 0


def test_error_sheets(spark, tmp_path):
    errors = spark.createDataFrame([(m, f"{i:02}", f"=q{i}", "g", "p", "abc"[i % 3], "" if i % 4 else "diakritika") for m in ("m", "n") for i in range(24)], "model string, id string, question string, gold string, prediction string, category string, error_type_auto string")
    sheet = labelling.error_sheet(errors, ["m", "n"], 9)
    assert {r.model: r["count"] for r in sheet.groupBy("model").count().collect()} == {"m": 9, "n": 9} and sheet.where("int(id) % 4 = 0").count() == 0
    logs.write_sheet(sheet.coalesce(1), f"{tmp_path}/sheet", mark=True)
    raw = next((tmp_path / "sheet").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfmodel,id,sual") and b"\t=q" in raw and b",=q" not in raw
    assert logs.read_sheet(spark, f"{tmp_path}/sheet").columns == sheet.columns
    filled = spark.createDataFrame([("m", "1", "Məsciд", " başqa dil ", None), ("m", "2", "Bakü", "başqa dil", "yenidən etiketləndi"), ("m", "3", "w", "faktual", ""), ("n", "4", None, "qızıl səhv", ""), ("n", "5", "x", "?", "yenidən etiketləndi")], "model string, id string, `modelin cavabı` string, etiket string, qeyd string")
    assert {(r.model, r.label): (r.n, round(r.share, 2)) for r in labelling.error_labels(filled).where("n > 0").collect()} == {("m", "başqa dil"): (2, 0.67), ("m", "faktual"): (1, 0.33), ("n", "qızıl səhv"): (1, 1.0)}
    assert labelling.error_labels(filled).count() == 10 and tuple(labelling.error_notes(filled).first()) == (4, 1, 1)
    assert tuple(labelling.confusion(filled).first()) == (5, 2, 1, 1, 0.5) and {r.id: r.letters for r in labelling.confusion_rows(filled).collect()} == {"1": "д", "2": ""}
    assert labelling.confusion(filled.limit(0)).first().share is None and labelling.is_subset()


def test_a_persons_answer_is_one_line(spark, tmp_path):
    rows = [(k, f"First{k}.\nsecond.\r\nthird other words of a question") for k in range(40)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.sql(f"create view benchmark as from '{tmp_path}/benchmark.parquet/*.parquet'")
    got = {r.category: (r.n, r.em) for r in readers.QUERIES["human_by_category"](spark, str(tmp_path)).collect()}
    assert any(em > 0 for _, em in got.values())
    assert got == {c: (n, em) for c, n, em in con.execute(f"select category, n, em from ({readers.ORACLES['human_by_category']})").fetchall()}
