"""Exact tests between pairs against all arrangements listed, and resampling against brute force."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from qiyas.operators import between, paired, statistics

SCHEMA = "label string, prompt_style string, excess double, low double, az_loss double, en_loss double, script string, base_family string, target string"


def ranks(values):
    first = {}
    for place, v in enumerate(sorted(values)):
        first.setdefault(v, place + 1)
    return [first[v] for v in values]


def listed(values, inside):
    n, k = len(values), sum(inside)
    stat = lambda chosen: sum(values[i] for i in chosen) / k - sum(values[i] for i in range(n) if i not in chosen) / (n - k)
    seen = stat([i for i in range(n) if inside[i]])
    every = [stat(c) for c in itertools.combinations(range(n), k)]
    return seen, sum(abs(x) >= abs(seen) - 1e-9 for x in every) / len(every), len(every)


def exact_of(spark, groups):
    rows = [(g, i, float(v), f) for g, (values, flags) in groups.items() for i, (v, f) in enumerate(zip(values, flags, strict=True))]
    df = spark.createDataFrame(rows, "g string, i int, v double, f boolean").repartition(3)
    return {r.g: r for r in between.exact_tests(df, ["g"], "i", "v", "f").collect()}


def test_exact_tests_equal_all_arrangements(spark):
    rng = random.Random(9)
    groups = {str(k): ([rng.choice([-2.5, 0.0, 1.0, 7.25, rng.random()]) for _ in range(n)], [i % 3 == 0 for i in range(n)]) for k, n in enumerate((2, 4, 7, 9, 11))}
    # complete separation reaches one arrangement of 126, and an extreme value pulls means but not ranks
    groups["apart"] = ([10, 9, 8, 7, 6, -1, -2, -3, -4], [True] * 5 + [False] * 4)
    groups["extreme"] = ([3, 2, 1, 0, -1, -100], [True] * 3 + [False] * 3)
    groups["mixed"] = ([1, 2, 3, 4, 5, 6, 7, 8, 9], [i % 2 == 0 for i in range(9)])
    got = exact_of(spark, groups | {"none": ([1, 2, 3], [False] * 3), "all": ([1, 2, 3], [True] * 3)})
    assert set(got) == set(groups)
    for g, (values, flags) in groups.items():
        observed, p, n = listed(values, flags)
        rank_diff, p_rank, _ = listed(ranks(values), flags)
        r = got[g]
        assert (r.observed, r.p_mean, r.arrangements, r.rank_diff, r.p_rank) == pytest.approx((observed, p, n, rank_diff, p_rank))
    assert got["apart"].arrangements == 126 and got["apart"].p_mean == pytest.approx(1 / 126)
    assert got["extreme"].observed > 30 and got["extreme"].rank_diff == pytest.approx(3)
    assert abs(got["mixed"].observed) < 1 and got["mixed"].p_mean > 0.5


def test_the_other_half_gives_the_same_p(spark):
    values, flags = [5, 4, 3, -1, -2, -3], [True, True, True, False, False, False]
    got = exact_of(spark, {"a": (values, flags), "b": (values, [not f for f in flags])})
    assert got["a"].p_mean == got["b"].p_mean and got["a"].p_rank == got["b"].p_rank


def test_families(spark):
    names = {"Qwen/Qwen3-VL-4B": "Qwen", "lab/Mistral-7B": "Mistral", "llama-3": "Llama", "google/gemma-3": "Gemma", "qwen/other": "digər", "x/Phi-4": "Phi", "x/FALCON": "Falcon"}
    df = spark.createDataFrame([(k,) for k in names], "name string").select("name", between.base_family(F.col("name")).alias("f"))
    assert {r.name: r.f for r in df.collect()} == names


def measured(spark):
    rows = [("p", "default", 4.0, 1.0, 5.0, 1.0, "kiril", "Qwen", "rus"), ("p", "oneshot", 9.0, 7.0, 8.0, -1.0, "kiril", "Qwen", "rus")]
    rows += [("q", "oneshot", 3.0, 1.0, -4.0, -7.0, "latın", "Gemma", "türk"), ("r", "default", -2.0, -3.0, 1.0, 3.0, "latın", "Llama", "bask")]
    rows += [("s", "default", 0.5, -1.0, 0.5, 0.0, "kiril", "Gemma", None), ("s", "other", 99.0, 98.0, 99.0, 0.0, "kiril", "Gemma", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_styles_are_preferred_in_order(spark):
    pick = lambda order: {r.label: (r.prompt_style, r.excess) for r in between.preferred(measured(spark), order).collect()}
    rules = between.STYLE_RULES
    assert pick(rules["default first"]) == {"p": ("default", 4.0), "q": ("oneshot", 3.0), "r": ("default", -2.0), "s": ("default", 0.5)}
    assert pick(rules["oneshot first"])["p"] == ("oneshot", 9.0)


def test_accounts_count_what_they_foretell(spark):
    rows = between.preferred(measured(spark), ("default", "oneshot"))
    got = {r.account: r for r in between.test_accounts(rows).collect()}
    # damaged: p alone, as q rose in az itself
    assert (got["script"].correct, got["base family"].correct, got["strength"].correct, got["kinship"].correct) == (3, 4, 2, 2)
    assert got["base family"].observed == pytest.approx(4 - 0.5) and got["base family"].pairs == 4
    one = between.confound(rows).first()
    assert tuple(one) == (1, 1, True)
    assert between.test_accounts(rows.where("script = 'kiril'")).where("account = 'script'").count() == 0
    rules = {r.rule for r in between.sensitivity(measured(spark)).collect()}
    assert rules == {"default first", "oneshot first"}
    assert between.sensitivity(measured(spark).where("label <> 'q'")).count() == 0
    assert between.test_accounts(rows.limit(0)).count() == 0


def test_pairs_fail_by_three_gates(spark):
    rates = [("t", "az", "s", 0.9, 0.0, 0.0, 0.0), ("b", "en", "s", 0.9, 0.21, 0.5, 0.9), ("x", "az", "s", 0.0, 0.0, 0.2, 0.31), ("y", "az", "s", 0.0, 0.0, 0.3, 0.0)]
    df = spark.createDataFrame(rates, "model string, language string, prompt_style string, empty_rate double, example_echo_rate double, question_echo_rate double, recoverable_rate double")
    pairs = spark.createDataFrame([("1", "t", "u"), ("2", "b", "t"), ("3", "x", "y")], "label string, base string, tuned string")
    got = {r.label: r.failures for r in paired.pair_gates(df, pairs).collect()}
    assert got == {"2": "b en s example echo", "3": "x az s extraction, y az s question echo"}


def digits(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def test_weights_and_signs_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.choice([0.0, 1.0]), rng.choice([0.0, 1.0])) for g in "ab" for i in range(30)] + [("c", i, 1.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, a double, b double").repartition(5)
    tops = statistics.poisson_thresholds()
    weight = lambda r, i: sum(t <= int(digits(0, r // 4, i)[8 * (r % 4) : 8 * (r % 4) + 8], 16) for t in tops)
    got = {r.g: r for r in statistics.bootstrap(df, ["g"], ["i"], ["a", "b"], resamples=50).collect()}
    flips = {r.g: r for r in statistics.permutation(df, ["g"], ["i"], "a", "b", permutations=100).collect()}
    for g in "abc":
        of = [r for r in rows if r[0] == g]
        for v, at in (("a", 2), ("b", 3)):
            means = sorted(sum(weight(r, x[1]) * x[at] for x in of) / n for r in range(50) if (n := sum(weight(r, x[1]) for x in of)))
            q = lambda p, means=means: (lambda k, f: means[k] + f * (means[min(k + 1, len(means) - 1)] - means[k]))(int(p * (len(means) - 1)), p * (len(means) - 1) % 1)
            assert (got[g][f"{v}_low"], got[g][f"{v}_high"], got[g][f"{v}_mean"]) == pytest.approx((q(0.025), q(0.975), sum(x[at] for x in of) / len(of)))
        d = [(x[1], x[2] - x[3]) for x in of]
        hits = sum(abs(sum(v if digits(0, r // 32, i)[r % 32] < "8" else -v for i, v in d)) >= abs(sum(v for _, v in d)) - 1e-12 for r in range(100))
        assert flips[g].p == pytest.approx((hits + 1) / 101)
    assert flips["c"].p == 1 and statistics.bootstrap(df.limit(0), ["g"], ["i"], ["a"]).count() == 0


def test_weights_are_poisson():
    tops = statistics.poisson_thresholds()
    share = [(b - a) / 2**32 for a, b in zip([0, *tops], [*tops, 2**32], strict=True)]
    assert share[:3] == pytest.approx([0.36788, 0.36788, 0.18394], abs=1e-4) and sum(k * s for k, s in enumerate(share)) == pytest.approx(1, abs=1e-6)


def test_resamples_of_a_group_are_dealt_to_many_tasks(spark):
    df = spark.createDataFrame([(1, i, 1.0) for i in range(50)], "g int, i int, v double")
    for out in (statistics.bootstrap_hash(df, ["g"], "i", "v"), statistics.bootstrap(df, ["g"], ["i"], ["v"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_r" in plan and "collect_list" not in plan and any("_r#" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
