import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qiyas.llm import mixing
from qiyas.llm.queries import OP12_SQL, op12_mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.sets(st.integers(0, 2), min_size=1)), min_size=1, max_size=3), st.lists(st.integers(0, 6), min_size=3, max_size=3))
def test_flow_is_a_largest_one_of_least_cost(patterns, quota):
    sizes, sources = [w for w, _ in patterns], [sorted(s) for _, s in patterns]
    got = mixing.routed(sizes, sources, dict(enumerate(quota)))
    assert all(sum(f.values()) <= 2 * w for f, w in zip(got, sizes, strict=True))
    assert all(sum(f.get(k, 0) for f in got) <= quota[k] for k in range(3)) and min((v for f in got for v in f.values()), default=0) >= 0
    cost = lambda totals: (-sum(totals), sum(max(0, t - w) for t, w in zip(totals, sizes, strict=True)))

    def possible(totals):  # Hall's condition: what a set of sources can't take must go elsewhere
        return all(sum(t for t, s in zip(totals, sources, strict=True) if set(s) <= set(held)) <= sum(quota[k] for k in held) for n in range(4) for held in itertools.combinations(range(3), n))

    best = min(cost(t) for t in itertools.product(*[range(2 * w + 1) for w in sizes]) if possible(t))
    assert cost([sum(f.values()) for f in got]) == best


def test_sql_and_edges(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(1)
    text = lambda n: " ".join(["w"] * n)
    docs = [(k, text(rng.randint(0, 90)), rng.choice(["b", "a", None, "ü", "hot", "hot", "hot"])) for k in range(300)]
    docs += [(500, None, "a"), (501, "", None), (502, text(30000), "long"), (503, "   ", "blank"), (504, text(3), "tiny")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in op12_mixing(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows == sorted(con.sql(OP12_SQL).fetchall()) == sorted(tuple(r) for r in op12_mixing(spark, str(tmp_path)).collect())
    by = {}
    for _, size, source_size, target, taken in rows:
        assert 0 <= taken <= 2 * size
        by.setdefault((source_size, target), []).append(taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 1
    assert abs(sum(t for _, t in by) - 1.5 * sum(r[1] for r in rows)) < 1e-3
    empty, quota = mixing.mixed(df.limit(0), F.array("source"))
    assert empty.count() == quota.count() == 0


def test_overlapping_sources(spark):
    # b has only shared documents, c is apart, and one document has no source
    rows = [(k, "w " * 10, ["a", "b"] if k % 2 else ["a"]) for k in range(40)] + [(100, "w " * 40, ["c", "c", None]), (101, "w", []), (102, "w", None), (103, "w " * 400, ["d"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, from array<string>")
    taken, quota = mixing.mixed(docs, F.col("from"))
    got = {r.doc_id: r for r in taken.collect()}
    q = {(r.source.none, r.source.name): r for r in quota.collect()}
    assert [q[False, s].number for s in "abcd"] + [q[True, ""].number] == [0, 1, 2, 3, 4]
    assert q[False, "a"].source_size == 400 and q[False, "b"].source_size == 200
    assert got[101].taken == got[102].taken == 0 and len(got) == len(rows)
    assert all(r.taken <= 2 * r.size for r in got.values())
    wanted = sum(q[False, s].target for s in "ab")
    assert abs(sum(got[k].taken for k in range(40)) - min(wanted, 800)) <= 2


def test_rows_that_are_equal_share_their_fate(spark):
    docs = spark.createDataFrame([(None, "w w w", "a")] * 50 + [(k, "w " * (k + 1), "a") for k in range(40)] + [(99, "w " * 500, "b")], "doc_id long, text string, source string")
    taken, quota = mixing.mixed(docs, F.array("source"))
    assert taken.where("doc_id is null").select("taken").distinct().count() == 1
    target = {r.source.name: r.target for r in quota.collect()}
    a = taken.where("size < 500").agg(F.sum("taken")).first()[0]
    assert target["a"] - 51 <= a <= target["a"] + 1
