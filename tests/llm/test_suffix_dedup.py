import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qiyas.llm import suffix_dedup as sd
from qiyas.llm.queries import op10_suffix_dedup


def brute(docs, width=100):
    """Over all windows in order; rows of equal id and text are one."""
    order = sorted({(d is not None, d or 0, t or "") for d, t in docs})
    seen, gone = set(), {}
    for known, d, t in order:
        raw = t.encode()
        cover = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                cover[i : i + width] = True
            seen.add(w)
        gone[d if known else None, t] = cover[: len(raw)]
    out = []
    for d, t in docs:
        c = gone[d, t or ""]
        edges = int(np.count_nonzero(np.diff(np.concatenate([[0], c.astype(int)])) == 1))
        raw = np.frombuffer((t or "").encode(), np.uint8)
        out.append((str(d), len(raw), int(c.sum()), edges, hashlib.sha256(raw[~c].tobytes()).hexdigest()))
    return sorted(out)


def some_docs():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(k) for k in (60, 99, 100, 130, 400, 1500)]
    docs = [(i, "".join(rng.choice([word(rng.randint(0, 150)), rng.choice(shared), shared[5][rng.randint(0, 700) : rng.randint(800, 1500)]]) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    edited = list(shared[5])
    for i in range(100, 1500, 130):
        edited[i] = "Z"
    docs += [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 100), (104, "x" * 350), (105, "ab" * 300), (106, "".join(edited)), (107, "short"), (108, word(70000) * 2), (None, shared[4]), (109, shared[4]), (109, shared[4]), (109, shared[3])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("hot", [sd.HOT_GROUP, 1])
def test_equals_brute_force(spark, hot):
    docs = some_docs()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, bytes string").repartition(4)
    rows = sd.deduplicated(df, hot).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows) == brute(docs)
    assert sd.deduplicated(df.limit(0)).count() == 0


def test_fixture_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_suffix_dedup(spark, sf).collect())
    assert got == brute(docs) and sum(r[2] for r in got) > 1000


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00", min_size=1, max_size=14), min_size=1, max_size=8))
def test_collection_is_the_sorted_suffixes(strings):
    raw = [s.encode() for s in strings]
    c = sd.Collection(raw, limit=3)
    suffixes = sorted((tuple(b + 1 for b in s[i:]) + (0,), m, i) for m, s in enumerate(raw) for i in range(len(s) + 1))
    # the ends of strings differ, in the order of the strings
    suffixes.sort(key=lambda x: (x[0][:-1] + (0, x[1])))
    assert c.bwt.tolist() == [raw[m][i - 1] + 1 if i else 0 for _, m, i in suffixes]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) - 1 and a[n] == b[n]:
            n += 1
        return min(n, 3)

    assert c.lcp.tolist()[1:] == [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]
