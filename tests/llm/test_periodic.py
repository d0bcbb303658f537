import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from qiyas.llm import periodic
from qiyas.llm.queries import op11_periodic_runs


def brute(words):
    """Every period in turn: stretches whose words agree with those one period on; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, z - a, q) for (a, z), q in found.items())


def row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def some_docs():
    rng = random.Random(3)
    docs = [(1, None), (2, ""), (3, "one two"), (4, " \t\n"), (4, " \t\n"), (None, "a a a a a a a b"), (5, "x " * 3000), (6, "a b " * 700 + "c " + "a b " * 700), (7, "é à " * 9 + "é")]
    docs += [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))) for k in range(10, 120)]
    docs += [(k, (" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) + "\n") * rng.randint(1, 9)) for k in range(200, 260)]
    return docs


def test_equals_brute_force(spark, tmp_path):
    docs = some_docs()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, runs string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((row(*d) for d in docs), key=str)
    assert rows(op11_periodic_runs(spark, str(tmp_path))) == want and sum(r[1] for r in want) > 50
    assert periodic.detected(df.limit(0)).count() == 0


def test_fixture_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(op11_periodic_runs(spark, sf)) == sorted((row(*d) for d in docs), key=str)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_stretches(parts):
    words = [w for part, k in parts for w in part * k]
    w = np.array(words, np.int64)
    assert periodic.document_runs(w, periodic.reach(w, np.zeros(len(w), np.int64))) == brute(words)


def test_long_runs_take_time_that_grows_with_length():
    w = np.zeros(200_000, np.int64)
    assert periodic.document_runs(w, periodic.reach(w, w)) == [(0, 200_000, 1)]
    w = np.tile(np.concatenate([np.zeros(500, np.int64), [1]]), 300)
    got = periodic.document_runs(w, periodic.reach(w, np.zeros(len(w), np.int64)))
    assert (0, 501 * 300, 501) in got and len(got) == 301
