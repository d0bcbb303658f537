"""Votes dealt anew in arrays: the same as dealt as rows, by brute force and by SQL."""

import hashlib

import duckdb
import numpy as np
import pytest

from qiyas.operators import dealing, statistics
from qiyas.plans.catalogue import QUERIES
from qiyas.plans.registry import ORACLES

VOTES = "model string, item_id long, letter string, key string"


@pytest.mark.parametrize("prefix", [b"", b"0|999|purchase|", b"p" * 48, b"p" * 49, b"p" * 120])
def test_md5_of_many_texts(prefix):
    ends = [b"%07d" % k for k in range(0, 9_999_999, 33_333)]
    got = dealing.md5_numbers(prefix, np.array([list(e) for e in ends], np.uint8).T)
    assert got.tolist() == [int(hashlib.md5(prefix + e).hexdigest()[:8], 16) for e in ends]


def test_votes_dealt_in_arrays_and_as_rows(spark):
    rows = [(m, i, "ABCDə"[(i * 7 + len(m)) % 3] if i % 11 else None, "ABCDə"[i % 4] if i % 13 else None) for m in ("a", "b", "ü", "long " * 12, "last") for i in range(-40, 90, 1 + len(m) % 3)]
    rows += [("a", None, "A", "B"), ("b", None, "A", "B"), (None, 3, "A", "B"), ("c", 10**18, "A", "B"), ("a", 10**18, "A", "B"), ("alone", None, "A", "B")]
    votes = spark.createDataFrame(rows, VOTES).repartition(5)
    found = [sorted(map(tuple, statistics.null_shuffle_hash(votes, 30, 5, blocks=7, in_arrays=most).collect())) for most in (3 << 20, 0)]
    assert found[0] == found[1] and [r for r, _ in found[0]] == list(range(30)) and len({n for _, n in found[0]}) > 1
    texts = spark.createDataFrame([(m, str(i), a, k) for m, i, a, k in rows if m is not None and i is not None], VOTES.replace("long", "string"))
    assert statistics.null_shuffle_hash(texts, 3).count() == 3  # items that aren't numbers
    assert statistics.null_shuffle_hash(votes.limit(0), 3).count() == 0


def test_no_shuffle_is_sorted_as_rows(spark):
    df = QUERIES["null_shuffle_hash_full"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "FlatMapGroupsInArrow" in plan


def test_shuffles_of_events_without_user_type_or_id_equal_the_sql(spark, tmp_path):
    rows = [(k if k % 17 else None, None if k % 19 == 0 else k * k % 40, None if k % 23 == 0 else "xyz"[k % 3]) for k in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted((r["round"], r.unanimous_wrong) for r in QUERIES["null_shuffle_hash"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(f"select round, unanimous_wrong from ({ORACLES['null_shuffle_hash']})").fetchall())
