import random

import duckdb
from hypothesis import HealthCheck, settings

from qiyas.llm import line_dedup
from qiyas.llm.queries import OP3_SQL, op3_line_dedup

settings.register_profile("slow", deadline=None, suppress_health_check=list(HealthCheck))


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute(docs):
    order = sorted({(d is not None, d or 0, k, d, t) for d, t in docs if t is not None for k in range(len(t.split("\n")))})
    seen, gone = [], {}
    for _, _, k, d, t in order:
        f = line_dedup.form(t.split("\n")[k])
        if f and any(f == g or len(f) >= 20 <= len(g) and within_one(f, g) for g in seen):
            gone.setdefault((d, t), set()).add(k)
        seen.append(f)
    out = []
    for d, t in docs:
        parts = [] if t is None else t.split("\n")
        g = gone.get((d, t), set())
        out.append((d, t if t is None else "\n".join(x for k, x in enumerate(parts) if k not in g), len(parts), len(g)))
    return out


def some_docs(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé ßÄ😀") for _ in range(rng.randint(15, 40))) for _ in range(12)]

    def edit(x):
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(x))
            x = rng.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "z" + x[i + 1 :]])
        return x

    return [(i, "\n".join(rng.choice(["", "ab", edit(rng.choice(base)), edit(rng.choice(base)).upper()]) for _ in range(rng.randint(1, 9)))) for i in range(60)]


def test_equals_brute_force(spark):
    docs = [*some_docs(1), (200, None), (201, ""), (202, "\n\n"), (203, "same line of enough length\n" * 3000), (None, "same line of enough length"), (204, "same line  of enough lengtH"), (205, "same line  of enough lengtH!"), (206, "rep\nrep"), (206, "rep\nrep")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, form string").repartition(5)
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in line_dedup.deduplicated(df).collect() if r.form == "clash")
    want = sorted((str(d), *x) for d, *x in brute(docs))
    key = lambda r: (r[0], r[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key)
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    want = sorted(con.sql(f"select doc_id, n_lines, n_removed, kept_sha256 from ({OP3_SQL})").fetchall())
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in op3_line_dedup(spark, sf).collect()) == want
    assert sum(r[2] for r in want) > 0


def test_earliest_of_a_slice_is_not_its_first_row(spark):
    """Equal forms in one slice whose rows don't stand in the order of doc_id: the earliest is the one that others meet."""
    f, g = "a line of enough length to be near", "a line of enough length to be nearx"
    p, q = "another line that many documents hold", "another line that many documents hald"
    cases = (
        [(9, f), (3, f), (5, g)],
        [(9, f), (3, g), (5, f)],
        [(9, g), (5, f), (3, g)],
        [(9, p), (3, p), (5, q)],
        [(5, p), (None, p), (3, q)],
        [(4, "x\n" + p), (4, p + "\ny"), (4, "v\n\n" + q), (3, "z")],
        sorted(some_docs(3), reverse=True),
    )
    for docs in cases:
        df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
        got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in line_dedup.deduplicated(df).collect())
        assert got == sorted((str(d), *x) for d, *x in brute(docs)), docs
