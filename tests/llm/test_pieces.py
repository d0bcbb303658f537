import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qiyas.llm import pieces

sp_lib = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")
MODEL = pieces.public_model()


def library(text):
    return sp_lib.SentencePieceProcessor(model_file=MODEL).encode(text)


def some_texts():
    rng = random.Random(3)
    words = ["the", "ationally", "x", "émile", "漢字仮名", "😀", "1234", "...", "\n", "", "", "unbelievable" * 3]
    out = [None, "", " ", "  ", "a", " lead", "trail ", "a  b   c", "\n\n", "tab\tx", "漢字" * 200, "abc" * 300, "é" * 100, "=" * 200]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(20)]
    out += ["".join(rng.choice("abcdefgh漢字é😀-=") for _ in range(400)) for _ in range(6)]
    return out


@pytest.mark.parametrize("chunk", [70, 200, 16384])
def test_equals_library(spark, chunk):
    docs = [(i, t) for i, t in enumerate(some_texts())] + [(5, " lead")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, ids string").repartition(3)
    rows = pieces.decoded(pieces.encoded(df, chunk=chunk).withColumn("raw", F.col("ids"))).collect()
    assert len(rows) == len(docs)
    text = dict(docs)
    for r in rows:
        t = text[r.doc_id]
        assert r.decoded == t and r.text_sha256 == (None if t is None else hashlib.sha256(t.encode()).hexdigest())
        assert (None if r.raw is None else np.frombuffer(bytes(r.raw), "<u4").tolist()) == (None if t is None else library(t)), (r.doc_id, t[:80])
    assert chunk > 1000 or max(r.n_chunks for r in rows) > 3
    assert pieces.encoded(df.limit(0)).count() == 0


def test_long_text(spark):
    t = "word and émile 漢字, " * 9000 + "z" * 30000
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = pieces.encoded(df).first()
    assert r.n_chunks > 5 and np.frombuffer(bytes(r.ids), "<u4").tolist() == library(t)


def test_scan_is_prefix_products():
    rng = np.random.default_rng(0)
    sizes = [1, 3, 2, 4, 3, 1]
    ms = [rng.normal(size=(a, b)) for a, b in zip(sizes, sizes[1:])]
    got, want = pieces.scan(ms), [ms[0]]
    for m in ms[1:]:
        want.append(pieces.times(want[-1], m))
    assert all(np.allclose(a, b) for a, b in zip(got, want))
