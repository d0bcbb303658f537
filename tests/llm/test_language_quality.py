import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from qiyas.llm import language_id as lid
from qiyas.llm import quality
from qiyas.llm.queries import op5_quality, op6_language

SF = "/root/testdata/sf0.01"


def test_held_out_matches_crc32(spark):
    df = spark.createDataFrame([(i,) for i in range(-5, 40)], "doc_id long").withColumn("h", lid.held_out(3, 1))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in df.collect())


def test_language_accuracy(spark):
    got = op6_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "123 !!", "en"), (4, "the house and the dog", "en"), (4, "the house and the dog", "en"), (5, "das haus und der hund " * 9000, "de")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in lid.predict(docs, lid.learn(docs)).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert [r.lang_pred for r in lid.predict(docs, lid.learn(docs.limit(0))).collect()] == ["und"] * 6
    assert lid.predict(docs.limit(0), {}).count() == 0


def test_quality_accuracy(spark):
    got = op5_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_quality_equals_blocked_brute_force_and_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "good plain words here", 1), (4, "!!! $$$ !!! $$$", 0), (4, "!!! $$$ !!! $$$", 0), (5, "x " * 200000, None)], "doc_id long, text string, label int")
    model = quality.learn(*quality.sample(docs.drop("label"), docs.select("doc_id", "label").distinct()))
    rows = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert rows[3] > 0.5 > rows[4] and all(0 <= s <= 1 for s in rows.values())
    alone = quality.vote(model, pa.array(["good plain words here"]))
    assert abs(alone[0] - rows[3]) < 1e-5
    assert rows[1] == rows[2] == model.prior
    assert quality.learn(*quality.sample(docs, docs.select("doc_id", "label").limit(0))) is None
    assert [r.score for r in quality.score(docs, None).collect()] == [0.5] * 6


def test_a_score_depends_on_its_text_alone(spark):
    """Blocked scoring equals one text after another, whatever stands next to it."""
    rng = random.Random(4)
    words = ["plain", "Words", "(here)", "end.", '"Quoted', "$$$", "é", "!?"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["Hello there world.", '"Quoted', "Hello there world.", "plain"]
    model = quality.learn([(t, k % 2) for k, t in enumerate(texts[:80])], 0.5)
    x = quality.count_features(pa.array(texts))
    for i in (0, 7, 299, 300, 302):
        assert (quality.count_features(pa.array([texts[i]]))[0] == x[i]).all()
    got = quality.vote(model, pa.array(texts))
    y = quality.unit(quality.weighted(x, model.weight) @ model.axes)
    for i in range(0, len(texts), 17):  # brute force: the votes of all neighbours
        near = [np.exp(quality.SHARPNESS * float(y[i] @ v)) * w for v, w in zip(model.vectors, model.votes, strict=True)]
        want = sum(n for n, label in zip(near, model.labels, strict=True) if label) / sum(near)
        assert abs(got[i] - want) < 1e-3
    assert got[300] == got[302]


def test_repeated_labels_and_ids(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k % 50} of copies", 1) for k in range(3000)] + [(1000 + k, f"other {k}", 0) for k in range(40)], "doc_id long, text string, label int")
    found, prior = quality.sample(docs, docs.select("doc_id", "label"), size=30)
    model = quality.fitted(docs, docs.select("doc_id", "label"), size=30)
    assert (model.vectors == quality.learn(found, prior).vectors).mean() > 0.9 and quality.fitted(docs.limit(0), docs.select("doc_id", "label")) is None
    assert sum(y for _, y in found) == 30 == sum(1 - y for _, y in found) and prior == 50 / 90


THREADS = """
import random, sys, numpy as np, pyarrow as pa
from qiyas.llm import quality
rng = random.Random(3)
words = ["plain", "Words", "(here)", "end.", '"Quoted', "$$$", "and", "so", "on"]
texts = [" ".join(rng.choice(words[: 3 + k % 7]) for _ in range(rng.randint(1, 40))) for k in range(400)]
model = quality.learn([(t, k % 2) for k, t in enumerate(texts[:300])] + [(f"text {k} of copies", 1) for k in range(60)], 0.4)
np.save(sys.argv[1], quality.vote(model, pa.array(texts)))
"""


def test_threads_do_not_change_scores(tmp_path):
    found = []
    for n in ("1", "4"):
        env = os.environ | {"OMP_NUM_THREADS": n, "OPENBLAS_NUM_THREADS": n, "PYTHONPATH": os.getcwd()}
        subprocess.run([sys.executable, "-c", THREADS, f"{tmp_path}/{n}.npy"], env=env, check=True, timeout=120)
        found.append(np.load(f"{tmp_path}/{n}.npy"))
    assert np.abs(found[0] - found[1]).max() <= 1e-6 and len(set(found[0].tolist())) > 100


def test_labels_of_absent_ids_take_no_place(spark):
    docs = spark.createDataFrame([(k, f"text {k} of some words", k % 2) for k in range(40)], "doc_id long, text string, label int")
    labels = docs.select("doc_id", "label").union(spark.range(1000, 41000).select("id", (F.col("id") % 2).cast("int")))
    rows, prior = quality.sampled(docs, labels, size=30)
    assert rows.count() == 40 and prior == 0.5
    assert quality.sampled(docs, labels, size=10)[0].count() == 20
