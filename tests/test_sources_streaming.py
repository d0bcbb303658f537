import json

from pyspark.sql import functions as F

from qiyas.sources import logs
from qiyas.streaming import append_log


def test_jsonl_keeps_bad_lines_and_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "az-001", "answer": "x"}\n\n{bad\n{"id": "az-002"}\n')
    rows = sorted(logs.read_jsonl(spark, str(tmp_path), logs.ITEM_SCHEMA).select("line", "id", "error").collect(), key=lambda r: r.line)
    assert [(r.line, r.id) for r in rows] == [(1, "az-001"), (3, None), (4, "az-002")] and rows[1].error == "{bad"


def test_runs_defaults_and_last_row(spark, tmp_path):
    rows = [{"id": "1", "raw_response": "old"}, {"id": "1", "raw_response": "new"}, {"id": "2", "model": "m", "language": "en", "raw_response": "x", "backend": {"provider": "p", "resolved_model": "r"}}]
    (tmp_path / "stem.jsonl").write_text("\n".join(map(json.dumps, rows)))
    runs = logs.read_runs(spark, str(tmp_path))
    got = {(r.model, r.language, r.prompt_style, r.id): r.raw_response for r in runs.collect()}
    assert got == {("stem", "az", "default", "1"): "new", ("m", "en", "default", "2"): "x"}
    assert {r.model: r.source for r in logs.provenance(runs).collect()} == {"stem": "local", "m": "api"}


def test_votes_sheets_and_names(spark, tmp_path):
    (tmp_path / "m__mcq.jsonl").write_text('{"id": "1", "model": "m", "raw_response": "Cavab: B"}\n{"id": "2", "model": "m", "raw_response": "?"}\n')
    assert [tuple(r) for r in logs.read_votes(spark, str(tmp_path)).collect()] == [("m", "1", "B")]
    logs.write_sheet(spark.createDataFrame([("=x", 1)], "a string, b int"), f"{tmp_path}/sheet")
    back = logs.read_sheet(spark, f"{tmp_path}/sheet")
    assert back.columns == ["a", "b"] and back.first().b == "1"
    assert logs.run_file_name("a/b:c", "az", "plain") == "a__b_c__az__plain.jsonl"
    ids = spark.createDataFrame([("az-009",), ("x",), ("az-1000",)], "id string")
    assert logs.next_free_id(ids).first().next_id == 1001


def test_stream_resumes_and_retries(spark, tmp_path):
    schema = "item_id long, answer string"
    items = lambda a, b: spark.createDataFrame([(i, str(i)) for i in range(a, b)], schema)
    respond = lambda df: df.select("item_id", F.upper("answer").alias("response"), (F.col("item_id") == 3).alias("failed"))
    go = lambda: append_log.run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), respond, "item_id", f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    items(0, 10).write.parquet(f"{tmp_path}/in")
    go()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 9
    items(5, 15).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == log.select("item_id").distinct().count() == 14
    assert [r.item_id for r in append_log.pending(items(0, 15), log, "item_id").collect()] == [3]
