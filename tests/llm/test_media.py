import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qiyas.llm import media
from qiyas.llm.scratch import Scratch

rng = random.Random(1)
SHARED = "".join(rng.choice("abcdefgh ") for _ in range(40000))
DOCS = [(1, None), (2, ""), (3, "é" * 288), (4, SHARED), (5, "intro " + SHARED + " outro"), (6, SHARED), (6, SHARED), (7, "x" * 300000), (8, "a" * 576), (9, "b" * 577)]


def test_whole_store(spark):
    df = spark.createDataFrame([(*d, "clash") for d in DOCS], "doc_id long, text string, bytes string").repartition(3)
    rows = media.stored_and_read(df).collect()
    assert len(rows) == len(DOCS)
    text = dict(DOCS)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        n = max(1, -(-len(raw) // 576)) * 576
        payload = raw + b"\xff" * (n - len(raw))
        stored = b"P5\n24 %d\n255\n" % (n // 24) + payload
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), n, len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.feature == media.features(payload)
    assert media.stored_and_read(df.limit(0)).count() == 0


def test_shared_chunks_are_kept_once(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    bitmap = media.shared_bitmap(media.chunk_digests(df))
    s = Scratch(spark, "t")
    lists, chunks = s.table(media.media_lists(df, bitmap), "m"), s.table(media.chunk_table(df, bitmap), "c")
    assert chunks.count() == chunks.select("digest").distinct().count() > 3
    refs = lists.selectExpr("doc_id", "size(filter(parts, p -> p.bytes is null)) k").groupBy("doc_id").sum("k").collect()
    assert dict(map(tuple, refs))[5] >= 5 and dict(map(tuple, refs))[1] >= 1
    broken = chunks.withColumn("bytes", chunks.bytes.substr(1, 0))
    with pytest.raises(Exception):
        media.read(media.joined(lists, broken)).collect()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_gear_equals_rolling(raw):
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert media.gear(np.frombuffer(raw, np.uint8)).tolist() == want
