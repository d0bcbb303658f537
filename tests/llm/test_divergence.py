import random
import re
from collections import Counter

import pytest

from qiyas.llm import divergence
from qiyas.llm.queries import OP13_SQL, op13_divergence
from qiyas.llm.scratch import Scratch


def brute(docs):
    """(lang, source, part, item, value, rank) with all terms of all pairs."""
    out, named = [], [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for t, a, b in docs]
    for lang in {d[0] for d in named}:
        df = Counter(t for d in named if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= 3)
        count = {s: Counter(t for d in named if d[:2] == (lang, s) for t in d[2] if df[t] >= 3) for s in {d[1] for d in named if d[0] == lang}}
        whole = sum(count.values(), Counter())
        share = lambda c, t, kept=kept: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        q = {t: share(whole, t) for t in kept}
        for s, c in count.items():
            p = {t: share(c, t) for t in kept}
            pair = [(sum(f(p[t], share(d, t)) for t in kept), o) for o, d in count.items() if o != s]
            term = [(f(p[t], q[t]), t) for t in kept if c[t] and p[t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, 200)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def some_docs():
    rng = random.Random(2)
    words = ["Apple", "pear", "ÉTÉ", "été", "日本", "x", "xx", "xxx", "😀", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]]
    docs = [(" ".join(rng.choices(words, k=rng.randint(0, 300))) + rng.choice([".", "-apple_pear", "\x00x", ""]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "", None])) for _ in range(90)]
    # ties behind a long beginning, a group without terms, a language without kept ones
    docs += [("z" * 3000 + chr(97 + k % 26) + chr(97 + k // 26), "tie", f"s{j}") for k in range(300) for j in range(3)] + [("0 1 2", "tie", "none"), (None, "tie", "null"), ("once", "rare", "a"), ("twice", "rare", "b"), ("big " * 100000, "en", "s1")]
    return docs


def test_equals_brute_force(spark, tmp_path):
    docs = some_docs()
    df = spark.createDataFrame([(k, *d, 1) for k, d in enumerate(docs)], "doc_id long, text string, lang string, source string, n int")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(op13_divergence(spark, str(tmp_path)))
    assert got == brute(docs)
    assert max(r[5] for r in got if r[2] == "term") == 200
    assert divergence.audited(df.limit(0)).count() == 0


def test_blocks_of_sources(spark, monkeypatch):
    docs = [(f"{t} all", "en", f"s{k}") for k in range(9) for t in ("a", "b", "a a", "c")[: k % 4 + 1]]
    df = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "PAIRS", 5)
    assert rows(divergence.audited(df)) == brute(docs)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_top_of_any_values(spark, k):
    rng = random.Random(k)
    rows_ = [(g, rng.choice([0, 1, 7, 1 << 20, (1 << 60) - 1, rng.randrange(1 << 60)]), f"{rng.choice(['', 'same', 'samé', 'é'])}{i}") for g in range(4) for i in range(60)] + [(9, 5, "alone")]
    s = Scratch(spark, "test")
    df = s.table(spark.createDataFrame(rows_, "g long, v long, item string"), "rows")
    want = [(g, v, i, r + 1) for g in (0, 1, 2, 3, 9) for r, (_, v, i) in enumerate(sorted(((-v, v, i) for h, v, i in rows_ if h == g), key=lambda x: (x[0], x[2].encode()))[:k])]
    assert sorted(tuple(r) for r in divergence.top(df, ["g"], "v", "item", k, s).collect()) == sorted(want)


def test_fixture_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    assert rows(op13_divergence(spark, sf)) == sorted(con.sql(f"select lang, source, part, item, value, rank from ({OP13_SQL})").fetchall())
