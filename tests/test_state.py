"""Streams that stop and go on, logs of many splits, and prompts."""

import itertools
import json
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from qiyas.functions import prompts
from qiyas.sources import logs
from qiyas.streaming import failures, snapshots


def in_order(calls, limit):
    """key -> (calls, failures, streak, longest, stopped), call by call."""
    out = {}
    for key, order, failed in sorted(calls, key=lambda c: c[1]):
        n, f, streak, longest, stopped = out.get(key, (0, 0, 0, 0, None))
        if stopped is None:
            streak = streak + 1 if failed else 0
            out[key] = (n + 1, f + failed, streak, max(longest, streak), order if streak >= limit else None)
    return out


def some_calls():
    rng = random.Random(8)
    return [(rng.choice("abcd"), i, rng.random() < 0.6) for i in range(60)]


def files(calls, size, folder):
    """One file a batch, whose times are in order."""
    os.makedirs(folder, exist_ok=True)
    for k in range(0, len(calls), size):
        part = calls[k : k + size][::-1]
        path = f"{folder}/{k:04}.parquet"
        pq.write_table(pa.table({"key": [c[0] for c in part], "n": pa.array([c[1] for c in part], pa.int64()), "failed": [c[2] for c in part]}), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))


def streamed(spark, tmp, name):
    stream = spark.readStream.schema("key string, n long, failed boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp}/{name}/in")
    found = failures.streaks(stream, "key", "n", "failed", 4)
    write = lambda batch, _: batch.write.mode("append").parquet(f"{tmp}/{name}/log")
    found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp}/{name}/state").trigger(availableNow=True).start().awaitTermination()
    return failures.latest(spark.read.parquet(f"{tmp}/{name}/log"), "key")


@pytest.mark.parametrize("size", [7, 20, 60])
def test_streaks_cross_batches(spark, tmp_path, size):
    calls = some_calls()
    files(calls, size, f"{tmp_path}/s/in")
    got = {r.key: (r.calls, r.failures, r.streak, r.longest, r.stopped) for r in streamed(spark, tmp_path, "s").collect()}
    want = in_order(calls, 4)
    assert got == want and {v[4] is None for v in want.values()} == {True, False}


def test_streaks_call_by_call_and_repeated():
    calls = some_calls()
    for size in (1, 7, 60):
        state = {}
        for k in range(0, len(calls), size):
            for part in (calls[k : k + size], calls[max(0, k - 3) : k + size]):  # the second time with what came before
                for key in {c[0] for c in part}:
                    of = [c for c in part if c[0] == key]
                    state[key] = failures.advanced(state.get(key), np.array([c[1] for c in of]), np.array([c[2] for c in of]), 4)
        assert {k: (s[1], s[2], s[3], s[4], s[0] if s[5] else None) for k, s in state.items()} == in_order(calls, 4)


def test_stopped_runs_are_left_out(spark, tmp_path):
    files([("a", i, True) for i in range(5)] + [("b", 9, False), ("b", None, True)], 10, f"{tmp_path}/s/in")
    found = streamed(spark, tmp_path, "s")
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert sorted(r.key for r in failures.going_on(runs, found, "key").collect()) == ["b", "c"]
    assert found.where("key = 'a'").first().calls == 4


EDIT = "id long, n long, text string"


def merge(spark, table, number, edits, publish=True):
    batch = spark.createDataFrame(edits, EDIT)
    table.write(snapshots.merged(table.read(), batch, "id", "n", F.col("text"), number), number)
    if publish:
        table.publish(number)


def rows(table):
    return {r.id: (r.n, r.text, r.first, r.checked) for r in table.read().collect()}


def test_edits_are_merged_and_only_touched_groups_checked(spark, tmp_path):
    t = snapshots.Snapshots(spark, f"{tmp_path}/t")
    assert t.latest() is None and t.read() is None
    merge(spark, t, 0, [(1, 1, "x"), (2, 1, "x"), (3, 1, "y"), (4, 1, "y"), (5, 1, None), (6, 1, "z"), (6, 2, "z2")])
    assert rows(t) == {1: (1, "x", 1, 0), 2: (1, "x", 1, 0), 3: (1, "y", 3, 0), 4: (1, "y", 3, 0), 5: (1, None, 5, 0), 6: (2, "z2", 6, 0)}
    # 1 moves from x to y: both groups are looked at again, z2 isn't; an older edit of 6 changes nothing
    merge(spark, t, 1, [(1, 5, "y"), (6, 1, "old"), (7, 1, None)])
    assert rows(t) == {1: (5, "y", 1, 1), 2: (1, "x", 2, 1), 3: (1, "y", 1, 1), 4: (1, "y", 1, 1), 5: (1, None, 5, 0), 6: (2, "z2", 6, 0), 7: (1, None, 7, 1)}


def test_a_batch_that_comes_again_or_stops_half_way(spark, tmp_path):
    t = snapshots.Snapshots(spark, f"{tmp_path}/t")
    merge(spark, t, 0, [(1, 1, "x"), (2, 1, "x")])
    before = rows(t)
    merge(spark, t, 1, [(2, 2, "y")], publish=False)  # stopped between write and publish
    assert rows(t) == before and t.latest() == 0
    merge(spark, t, 1, [(2, 2, "y")])
    after = rows(t)
    assert t.latest() == 1 and after[2] == (2, "y", 2, 1)
    merge(spark, t, 2, [(2, 2, "y")])  # the same edits once more
    assert rows(t) == after and {n for n in os.listdir(f"{tmp_path}/t") if n.startswith("version=")} == {"version=1", "version=2"}


def test_review_stream_replays(spark, tmp_path):
    schema = "id long, n long, text string"
    go = lambda: snapshots.run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "id", "n", lambda: F.col("text"), f"{tmp_path}/t", f"{tmp_path}/state").awaitTermination()
    spark.createDataFrame([(i, 1, str(i % 3)) for i in range(9)], schema).write.parquet(f"{tmp_path}/in")
    go()
    t = snapshots.Snapshots(spark, f"{tmp_path}/t")
    first = rows(t)
    go()  # nothing new
    assert rows(t) == first and t.latest() == 0
    spark.createDataFrame([(1, 2, "0")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    assert rows(t)[1] == (2, "0", 0, 1) and rows(t)[4] == (1, "1", 4, 1) and rows(t)[2] == (1, "2", 2, 0)
    # the stream forgets that the last batch was done: it comes again under the same number
    for name in ("1", ".1.crc"):
        os.remove(f"{tmp_path}/state/commits/{name}")
    go()
    assert rows(t)[1] == (2, "0", 0, 1) and t.latest() == 1


def test_lines_of_files_of_many_splits(spark, tmp_path):
    rng = random.Random(6)
    want = {}
    for name, n in (("a.jsonl", 500), ("b.jsonl", 300), ("empty.jsonl", 0), ("long.jsonl", 3)):
        lines = [rng.choice([json.dumps({"id": f"{name}-{i}", "answer": "é" * rng.randint(0, 60)}), "", "   "]) for i in range(n)]
        if name == "long.jsonl":
            lines[1] = json.dumps({"id": "long", "answer": "x" * 20000})
        text = "\n".join(lines) + ("\n" + '{"id": "torn' if name == "b.jsonl" else "\n" if name == "a.jsonl" else "")
        (tmp_path / name).write_text(text)
        for i, line in enumerate([*lines, '{"id": "torn'] if name == "b.jsonl" else lines):
            if line.strip():
                want[name, i + 1] = json.loads(line)["id"] if line.endswith("}") else None
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows_ = logs.read_jsonl(spark, str(tmp_path), logs.ITEM_SCHEMA).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {(r.file, r.line): r.id for r in rows_} == want and len(rows_) == len(want)
    assert [r.error for r in rows_ if r.error] == ['{"id": "torn']


def test_prompts_are_filled_once(spark):
    df = spark.createDataFrame([("a {question} b {options} c", "q {options} {question}", ["{question}", "$1 \\ {options}"]), ("{question}{options}", "", []), ("no field", "q", ["x"]), ("{question}", None, ["x"])], "t string, q string, o array<string>")
    got = [tuple(r) for r in df.select(prompts.build_choice_prompt(F.col("t"), F.col("q"), F.col("o")), prompts.build_prompt(F.col("t"), F.col("q"))).collect()]
    assert got == [("a q {options} {question} b A) {question}\nB) $1 \\ {options} c", "a q {options} {question} b {options} c"), ("", "{options}"), ("no field", "no field"), (None, None)]


def test_styles(spark):
    styles = prompts.style_table(spark)
    assert styles.count() == 10 and {(r.prompt_style, r.language) for r in styles.collect()} == set(itertools.product(("default", "script", "zeroshot", "plain", "oneshot"), ("az", "en")))
    ask = lambda s, g: prompts.prompted(spark.createDataFrame([(s, g, "Q?")], "prompt_style string, language string, question string"), styles).first().prompt
    assert ask("zeroshot", "en") == "Answer the following question briefly. Write only the answer.\n\nQuestion: Q?\nAnswer:"
    for style, language in (("none", "az"), ("default", "tr")):
        with pytest.raises(Exception, match="unknown prompt style"):
            ask(style, language)
    prefix = styles.select(prompts.prompt_prefix(F.col("template")).alias("p"), "template").collect()
    assert all(r.template.startswith(r.p) and "{question}" not in r.p for r in prefix)
