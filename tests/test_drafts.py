"""Raw lines, aliases, manual rows and back-ends on small rows."""

import json

import duckdb
from pyspark.sql import functions as F

from qiyas.operators import drafts
from qiyas.plans import written
from qiyas.streaming import append_log

GOOD = {"id": "az-001", "question_az": "Ən uca dağ?", "question_en": "q", "answer": "x", "answer_en": "x", "category": "science", "source": "s", "provenance": "manual", "verified_by": "human"}


def issues(spark, *records):
    rows = [(i + 1, r if isinstance(r, str) else json.dumps(GOOD | r, ensure_ascii=False)) for i, r in enumerate(records)]
    found = drafts.validate_lines(spark.createDataFrame(rows, "line long, raw string")).collect()
    return sorted((r.line, r.severity[0], r.field or "", r.message) for r in found)


def test_every_rule_of_a_line(spark):
    cases = [
        ("{bad", [("e", "", "bad JSON")]), ("3", [("e", "", "not an object")]), ("[{}]", [("e", "", "not an object")]), ("null", [("e", "", "not an object")]), ("  ", []),
        ({"extra": [1]}, [("w", "extra", "unknown field")]), ({"answer_aliases": {"a": 1}}, [("e", "answer_aliases", "not a list")]), ({"answer_aliases": "a"}, [("e", "answer_aliases", "not a list")]),
        ({"answer_aliases": ["a", " "]}, [("e", "answer_aliases", "blank alias")]), ({"answer_aliases": ["a", 1]}, [("e", "answer_aliases", "blank alias")]), ({"answer_aliases": []}, [("w", "answer_aliases", "empty list")]), ({"answer_aliases": None, "notes": "n", "difficulty": None}, []),
        ({"question_az": "Bu nece seher?"}, [("w", "question_az", "lost diacritics")]), ({"question_az": "Bu nece şəhər?"}, []), ({"question_az": "Qurban harada?"}, []),
        ({"answer": "Cairo!"}, [("e", "answer", "answer of the prompt's examples")]), ({"answer": "Cairo", "verified_by": "pending"}, [("w", "verified_by", "not verified by a human")]),
        ({"difficulty": 3}, [("e", "difficulty", "unknown value")]), ({"difficulty": "odd"}, [("e", "difficulty", "unknown value")]), ({"source": 5}, [("e", "source", "missing or blank")]),
        ({"category": "x", "provenance": "y"}, [("e", "category", "unknown value"), ("e", "provenance", "unknown value")]), ({"question_az": "uca dağ"}, [("w", "question_az", "no final mark")]), ({"question_az": "Uca x dağ?"}, [("w", "answer", "occurs in the question")]),
    ]
    rows = [r if isinstance(r, str) else {"id": f"az-{100 + i}", "question_az": f"Ən uca {i} dağ?"} | r for i, (r, _) in enumerate(cases)]
    assert issues(spark, *rows) == sorted((i + 1, *x) for i, (_, found) in enumerate(cases) for x in found)
    assert issues(spark, {}, {"question_az": "ən UCA dağ."}) == [(2, "e", "id", "duplicate id"), (2, "w", "question_az", "duplicate question")]
    assert [x[2:] for x in issues(spark, {"id": "a1"})] == [("id", "pattern")] and issues(spark, "") == []


def test_aliases_are_filled(spark):
    rows = [(1, "Bakı", "Baku", None), (2, "Bakı", "Baku", ["mine"]), (3, " ", "x", None), (4, "fransız dili", "French", []), (5, None, None, None)]
    df = spark.createDataFrame(rows, "k int, answer string, answer_en string, answer_aliases array<string>")
    got = {r.k: r for r in drafts.fill_aliases(df).collect()}
    assert got[1].filled and "Bakıda" in got[1].answer_aliases and "Bakı" not in got[1].answer_aliases
    assert not got[2].filled and got[2].answer_aliases == ["mine"] and not got[3].filled and not got[5].filled
    assert {"fransız", "dili", "fransızda", "fransız dilində"} <= set(got[4].answer_aliases) and len(set(got[4].answer_aliases)) == len(got[4].answer_aliases)
    over = {r.k: r for r in drafts.fill_aliases(df, overwrite=True).collect()}
    assert over[2].filled and over[2].answer_aliases[0] == "mine" and "Bakıda" in over[2].answer_aliases


def test_manual_rows(spark):
    rows = [(2, "q", "q", "Bakı", "Baku", "geography", "s", None), (1, "q", " ", "x", None, "odd", "s", ["y"]), (3, None, None, None, None, None, None, None)]
    ready, problems = drafts.prepare_manual(spark.createDataFrame(rows, "o int, question_az string, question_en string, answer string, answer_en string, category string, source string, answer_aliases array<string>"), ["o"], start=9)
    got = {r.o: r for r in ready.collect()}
    assert [got[k].id for k in (1, 2, 3)] == ["az-009", "az-010", "az-011"] and {r.verified_by for r in got.values()} == {"human"} and got[2].difficulty == "medium" and got[2].notes == ""
    assert got[1].answer_aliases[0] == "y" and "Bakının" in got[2].answer_aliases and got[3].answer_aliases is None
    found = sorted(tuple(r) for r in problems.collect())
    assert found == [(1, "no category: odd"), (1, "not filled in: question_en, answer_en"), (3, "not filled in: question_az, question_en, answer, answer_en, category, source")]


def test_back_ends(spark):
    golds = spark.createDataFrame([(i, f"g{i}") for i in range(200)], "id int, gold string")
    items = golds.select("id").union(spark.createDataFrame([(999,)], "id int"))
    got = {r.id: r.response for r in append_log.oracle(items, golds, "id", accuracy=0.6).collect()}
    right = sum(got[i] == f"g{i}" for i in range(200))
    assert 95 < right < 145 and len(got) == 201 and set(got.values()) <= {"", *(f"g{i}" for i in range(200))}
    assert all(r.response == f"g{r.id}" for r in append_log.oracle(golds, golds, "id", accuracy=1).collect())
    assert [r.response for r in append_log.oracle(items, golds.limit(0), "id").limit(3).collect()] == ["", "", ""]
    assert append_log.answered(items, lambda df: append_log.echo(df, "id")).where("response = ''").count() == 201


def test_kinds_of_failure(spark):
    schema = "model string, item_id int, raw_response string"
    written = spark.createDataFrame([("m", 1, "да"), ("m", 2, "QAHIRƏ"), ("m", 3, None), ("m", 4, "h2o Мысыр"), ("n", 1, "x")], schema)
    choices = spark.createDataFrame([("m", 1, "B"), ("m", 2, "?"), ("m", 3, "А")], schema)
    got = {r.model: (r["items"], r.cyrillic, r.echo, r.choices, r.no_letter, r.cyrillic_choices) for r in drafts.written_kinds(choices, written).collect()}
    assert got == {"m": (4, 2, 2, 3, 2, 1), "n": (1, 0, 0, 0, 0, 0)} and written.where(F.col("item_id") > 9).count() == 0


def test_lines_of_more_than_four_digits(spark, tmp_path):
    ids = [*range(995, 1010), *range(9995, 10025), 100001, 100002]
    spark.createDataFrame([(k, f"Text {k} zzz") for k in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    got = written.QUERIES["validate_lines"](spark, str(tmp_path))
    columns = ", ".join(got.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(f"select {columns} from ({written.ORACLES['validate_lines']})").fetchall()))
