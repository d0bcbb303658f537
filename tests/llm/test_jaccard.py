import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from qiyas.llm import jaccard_join as jj
from qiyas.llm.components import components
from qiyas.llm.queries import OP1_SQL, op1_ngram_jaccard
from qiyas.llm.scratch import Scratch


def grams(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(docs):
    sets = [grams(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(find(i), []).append(d)
    smallest = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted((str(d), len(sets[i]), str(smallest(least[find(i)]))) for i, (d, _) in enumerate(docs))


def some_docs(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    docs = []
    for i in range(n):
        words = list(rng.choice(bases))
        if rng.random() < 0.4:
            words = passage + words[: rng.randint(0, 14)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return docs


def test_equals_brute_force(spark, monkeypatch):
    docs = [*some_docs(1), (900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "one two three four"), (906, "one two three four five"), (None, "one"), (None, "lonely words stand here alone now"), (907, "é É x y z w"), (907, "other text with the same id here"), (908, "long text of many words " * 20000)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, set_id string").repartition(4)
    monkeypatch.setattr(jj, "GROUP", 3)
    monkeypatch.setattr(jj, "QUERIES", 2)
    for rounds in (3, 1):
        monkeypatch.setattr(jj, "ROUNDS", rounds)
        monkeypatch.setattr(jj, "SEEDS", jj.SEEDS[:rounds])
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jj.joined(df).collect())
        assert got == brute(docs)
    assert jj.joined(df.limit(0)).count() == 0


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    want = sorted(con.sql(f"select doc_id, n_shingles, component_id from ({OP1_SQL})").fetchall())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in op1_ngram_jaccard(spark, sf).collect()) == want
    assert any(a != c for a, _, c in want)


def test_components_of_a_long_path(spark):
    ids = list(range(60))
    random.Random(2).shuffle(ids)
    pairs = [*zip(ids, ids[1:]), (100, 101), (101, 102), (100, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t"), "c").collect()))
    assert got == {i: 0 for i in range(1, 60)} | {101: 100, 102: 100}


@given(st.integers(1, 400), st.integers(1, 400))
@settings(deadline=None)
def test_prefixes_meet(a, b):
    """Two linked sets share a token in the index prefix of the smaller and the probe prefix of the larger."""
    a, b = min(a, b), max(a, b)
    both = jj.needed(a + b)
    if both <= a:
        assert 100 * both >= 75 * (a + b - both) > 0 and 100 * (both - 1) < 75 * (a + b - both + 1)
        # the worst order: all tokens of their own come first
        assert a - both < jj.index_length(a) and b - both < jj.probe_length(b)
