"""Queries that cover the whole of their tables or settings, against brute force."""

import hashlib
import itertools

import pytest

from qiyas.operators import paired, scoring, statistics
from qiyas.plans import synthetic
from qiyas.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def permuted(values, inside):
    n, k, total = len(values), sum(inside), sum(values)
    stat = lambda s: s / k - (total - s) / (n - k)
    observed = stat(sum(v for v, g in zip(values, inside, strict=True) if g))
    hits = count = 0
    for chosen in itertools.combinations(values, k):
        count += 1
        hits += abs(stat(sum(chosen))) >= abs(observed) - 1e-9
    return round(observed, 9), round(hits / count, 9), count


def test_exact_permutation_of_the_whole_table(spark):
    (got,) = QUERIES["exact_permutation_nations"](spark, SF).collect()
    keys = sorted(r.n_nationkey for r in spark.read.parquet(f"{SF}/nation.parquet").collect())
    assert len(keys) == 25
    assert (got.observed, got.p, got.arrangements) == permuted([float(k * 37 % 11) for k in keys], [k % 3 == 0 for k in keys])


def test_exact_permutation_leaves_no_nation_out(spark):
    keys = sorted(r.n_nationkey for r in spark.read.parquet(f"{SF}/nation.parquet").collect())
    (got,) = QUERIES["exact_permutation"](spark, SF).collect()
    assert (got.observed, got.p, got.arrangements) == permuted([float(k * 37 % 11) for k in keys], [k % 3 == 0 for k in keys])


@pytest.mark.parametrize("values", [[0.1 * k for k in range(18)], [1.5, -2.25, 1e6, 0.3, 0.3, -7.0, 2.0], [1.0] * 6])
def test_counted_arrangements(values):
    inside = [k % 3 == 1 for k in range(len(values))]
    observed, p, n = statistics.counted_arrangements(values, inside)
    assert (round(observed, 9), round(p, 9), n) == permuted(values, inside)
    with pytest.raises(ValueError):
        statistics.counted_arrangements(values, [False] * len(values))


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def percentile(values, q):
    at = q * (len(values) - 1)
    low = int(at)
    values = sorted(values)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def bounds(x, resamples=1000):
    means = [sum(x[uniform(0, r, i) % len(x)] for i in range(len(x))) / len(x) for r in range(resamples)]
    return percentile(means, 0.025), percentile(means, 0.975)


def test_excess_interval_is_a_bootstrap(spark):
    # skewed: one item of twelve loses in az
    loss = [1.0] + [0.0] * 11
    rows = [(m, g, "default", i, 1.0 - (loss[i] if (m, g) == ("t", "az") else 0.0), 1.0, "x") for m in "bt" for g in ("az", "en") for i in range(12)]
    scores = spark.createDataFrame(rows, "model string, language string, prompt_style string, item_id long, em_strict double, em_translit double, prediction string")
    (got,) = paired.excess_damage(scores, spark.createDataFrame([("p", "b", "t")], "label string, base string, tuned string")).collect()
    assert (got.low, got.high) == pytest.approx(bounds(loss)) and got.low == 0 and got.verdict == "no difference"
    a, b = (QUERIES[x](spark, SF).collect() for x in ("excess_damage", "excess_damage_bootstrap"))
    assert len(a) == len(b) > 0


def shuffled(votes, r):
    dealt = {}
    for model in {v.model for v in votes}:
        of = sorted((v for v in votes if v.model == model), key=lambda v: v.item_id)
        order = sorted(of, key=lambda v: (uniform(0, r, model, v.item_id), v.item_id))
        for place, vote in zip(of, order, strict=True):
            dealt.setdefault((place.item_id, place.key), []).append(vote.letter)
    return sum(len(x) >= 2 and len(set(x)) == 1 and x[0] != key for (_, key), x in dealt.items())


def test_resampling_queries_at_their_full_settings(spark):
    votes = synthetic.votes(spark, SF).collect()
    got = {r["round"]: r.unanimous_wrong for r in QUERIES["null_shuffle_hash_full"](spark, SF).collect()}
    assert sorted(got) == list(range(1000))
    assert all(got[r] == shuffled(votes, r) for r in (0, 19, 20, 500, 999))
    scores = scoring.scored(synthetic.runs(spark, SF)).where("prompt_style = 'default'").orderBy("item_id").collect()
    for r in QUERIES["bootstrap_hash_full"](spark, SF).collect()[:2]:
        x = [s.em_strict for s in scores if (s.model, s.language) == (r.model, r.language)]
        assert r.n == len(x) and (r.low, r.high) == pytest.approx(bounds(x), abs=1e-8)


@pytest.fixture
def folder(spark, tmp_path):
    opening, rest = "one two three four five six seven eight", "nine ten eleven twelve thirteen"
    texts = [(1, f"before {opening} {rest} after"), (2, f"{opening} and then other words"), (3, f"{opening} and then more words"), (4, f"{opening} and then other words"), (10, f"{opening} 9 10"), (11, f"{opening}\n1 word"), (12, f"{opening} 2 word")]
    spark.createDataFrame([(*t, "en") for t in texts], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, f"{opening} {rest}"), (1, "  ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_leaks_are_whole_texts(spark, folder):
    assert [tuple(r) for r in QUERIES["leak_check_whole"](spark, folder).collect()] == [(1, 0)]
    assert QUERIES["leak_check"](spark, folder).count() == 7


def test_questions_are_whole_texts(spark, folder):
    rows = QUERIES["validate_items_whole"](spark, folder).collect()
    lines = lambda message: sorted(r.line for r in rows if r.message == message)
    # 2 and 4 are equal, 11 and 12 but for the answer
    assert lines("duplicate question") == [4, 12]
    assert lines("occurs in the question") == [10]


def test_shuffles_of_votes_are_not_broadcast(spark):
    # models with items of their own, and fewer shuffles than blocks
    rows = [(m, i, "ABCD"[(i * k) % 4], "ABCD"[i % 4]) for k, m in enumerate(("x", "y", "z"), 1) for i in range(k, 60, k)]
    votes = spark.createDataFrame(rows, "model string, item_id long, letter string, key string")
    got = statistics.null_shuffle_hash(votes, 30, blocks=7)
    found = votes.collect()
    assert {r["round"]: r.unanimous_wrong for r in got.collect()} == {r: shuffled(found, r) for r in range(30)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_queries_grow_with_their_tables(spark, tmp_path):
    keys = [0, 1, 2, 3, 5, 5, 9, 49, 53, 2003, 2021, 2027]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in (0, 30, 110, 111, 3000)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    # 2021 is 43 * 47
    assert rows("primes") == [(2, 1, 3), (3, 2, 5), (5, 3, 53), (53, 4, 2003), (2003, 5, 2027), (2027, 6, None)]
    assert rows("ordinal_suffix") == [("0", "ci"), ("110", "cu"), ("111", "ci"), ("30", "cu"), ("3000", "ci")]
    assert rows("kappa_bands") == [(0, -0.1, "poor"), (30, 0.2, "fair"), (110, 1.0, "almost perfect"), (111, -0.1, "poor"), (3000, -0.07, "poor")]
