import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qiyas.llm import packing
from qiyas.llm.queries import op7_packing

SCHEMA = "doc_id long, text string, length string"


def check(rows, docs):
    """Every document's ids once, in order; every sequence gapless and not too long."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(x[-1]) <= 1024
    return len(by)


def test_edges(spark):
    long = "word and another one, again! " * 3000
    docs = [(1, None), (2, ""), (3, "a  b \n c"), (3, "a  b \n c"), (4, long), (5, long), (6, "<|endoftext|> x"), (9, "a <|endoftext|><|endoftext|>\n b<|endoftext|>"), (7, "é ü  \t\n  z "), (8, "x" * 5000)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA)
    check(packing.packed(df).collect(), docs)
    assert packing.packed(df.limit(0)).count() == 0


def test_fixture_is_near_optimal(spark):
    rows = op7_packing(spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    used = check(rows, docs)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=20))
def test_plan_uses_every_piece_once(lengths):
    h = np.zeros(41, np.int64)
    for k, v in lengths.items():
        h[k] = v
    planned = packing.plan(h, 40)
    got = Counter()
    for ls, n in planned:
        assert sum(ls) <= 40 and n > 0
        for v in ls:
            got[v] += n
    assert got == Counter(lengths)
    covered = Counter()
    for v, a, b, *_ in packing.runs(planned):
        assert a == covered[v]
        covered[v] = b
    assert covered == got
