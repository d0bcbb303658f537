import hashlib
import re
import unicodedata

import pytest

from qiyas.llm import fingerprints as fp

TEXTS = ["Straße  ONE", "strasse one", " STRASSE\tone\n", "ﬁne ½", "fine 1⁄2", None, "", "x", "ab", "ab", "été", "été", "😀😀 ok", "long " * 20000, "long " * 20000 + "er", "a b", "a b", "abc", "abd"]


def form(text):
    n = unicodedata.normalize
    return re.sub(r"[\s\x85]+", " ", n("NFKC", n("NFKC", text).casefold())).strip(" ")


def expect(docs):
    docs = sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    out = []
    for i, (d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out.append((d, t, e, nxt))
    return out


@pytest.mark.parametrize("bits", [64, 3])
def test_equals_brute_force(spark, bits):
    docs = [(i * 7, t) for i, t in enumerate(TEXTS)] + [(14, "tie"), (14, "tie"), (10**15, "far"), (None, "none")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, h string").repartition(4)
    rows = fp.fingerprinted(df, bits).collect()
    want = expect(docs)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=lambda r: (key(r), r[1:])) == sorted(((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in want), key=lambda r: (key(r), r[1:]))
    # fingerprints are equal exactly where canonical forms are
    seen = {}
    by = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in rows}
    for d, t, e, n in want:
        r = by[d, len(t), hashlib.sha256(e.encode()).hexdigest()]
        for text, got in ((t, r.fingerprint), (e, r.edited_fingerprint)):
            assert seen.setdefault(form(text), got) == got
        assert r.near_edited == float(form(t) == form(e)) and r.near_next == float(form(t) == form(n))
    assert len(set(seen.values())) == len(seen)


def test_empty_and_single(spark):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    r = fp.fingerprinted(one).first()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.fingerprinted(one.limit(0)).count() == 0


def test_blocks_look_ahead_over_gaps(spark):
    ids = [*range(2000), *range(10**12, 10**12 + 500), 2**61]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    rows, parts = fp.in_blocks(df)
    assert rows.select("block").distinct().count() >= 8
    got = {r.doc_id: r.next_doc_id for r in fp.with_next(rows, parts, ["doc_id"]).collect()}
    assert got == {a: b for a, b in zip(ids, ids[1:] + ids[:1])}
