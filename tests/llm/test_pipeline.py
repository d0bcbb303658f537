import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from qiyas.llm import jaccard_join, line_dedup, secrets
from tests.llm.test_jaccard import brute as components_of
from tests.llm.test_line_dedup import brute as lines_of

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
    texts = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames[:5]]
    assert all(f.columns == columns for f in frames[:5])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = [d for d, q in labels.items() if (d in texts[1]) != bool(q)]
    assert len(wrong) <= 0.05 * len(labels) and all(texts[1][d] == texts[0][d] for d in texts[1])
    want = {d: t for d, t, _, gone in lines_of(list(texts[1].items())) if not (gone and not re.search(r"\S", t))}
    assert texts[2] == want and len(want) < len(texts[1])
    least = {int(d): (n, c) for d, n, c in components_of(list(texts[2].items()))}
    assert texts[3] == {d: t for d, t in texts[2].items() if not least[d][0] or least[d][1] == str(d)}
    assert texts[4].keys() == texts[3].keys()
    packed = frames[5].collect()
    assert {r.doc_id for r in packed} == set(texts[4])
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_stages_on_edges(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some plain words that stand here alone", "en", "a", 5), (3, "some plain words that stand here alone", "en", "a", 5), (None, "word", "en", None, 4)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_removed long, _spans string")
    for given in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, given, SF)
            assert got.count() == given.count() if k else got.count() <= given.count()
            assert k == 4 or got.columns == docs.columns and all(r.n_removed == 7 and r["_spans"] == "x" for r in got.collect())
