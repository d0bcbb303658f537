"""Secret scans with corpus-wide ownership frequency, on built-in functions alone.

Patterns find candidate credentials: assignments, access keys, hexadecimal strings, and
other long tokens. The hash of every candidate is counted over the corpus: in how many
repositories and under how many owners it occurs. A candidate that many owners hold is
an example that was copied; one that stays with few owners and looks random is live.
Base candidates (assign, access, hex) are always reported; a token is reported only
if it is live.

Defined results: null text is empty and has no spans; a null owner is an owner of its
own; repeated rows are scanned each, those of equal doc_id and text are one repository; equal starts are
in the order of KINDS; extra columns are not read; an empty table gives an empty result.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qiyas.llm.scratch import Scratch, free_name

KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of these is greedy, so a least length is the same as dropping shorter runs.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
LEAST_VALUE = 8
#: Held by so many owners in so many repositories or more, a candidate is an example.
WIDE_OWNERS = 3
#: A live value has so many distinct characters at least.
VARIED = 8


def matches(text: Column, kind: int, pattern: str) -> Column:
    """Array of (start, kind, end, value) of the leftmost matches that don't overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == 0 else 0))
    # between matches i - 1 and i lies the i-th piece, so starts are running sums of lengths
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), value.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["found"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["value"].alias("value"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(p["found"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    spans = F.aggregate(parts, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(zero["out"])


def varied(value: Column) -> Column:
    """Letters and digits, and many different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= VARIED)


def scanned(docs: DataFrame, owner: str) -> DataFrame:
    """row, doc_id, text_key, owner and candidates (start, kind, end, hash, random) of each text; the text itself stays behind."""
    text = F.coalesce("text", F.lit(""))
    at = docs.select("doc_id", text.alias("text"), F.col(owner).alias("owner"))
    each = [matches(F.col("text"), k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))]
    long_enough = F.filter(each[0], lambda s: F.length(s["value"]) >= LEAST_VALUE)
    mixed = F.filter(each[3], lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]"))
    base = F.concat(long_enough, each[1], each[2])
    found = at.select("doc_id", "owner", F.xxhash64("text").alias("text_key"), base.alias("base"), mixed.alias("tokens"))
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    hashed = lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash"), varied(s["value"]).alias("random"))
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", "owner", F.transform(F.array_sort(F.concat("base", apart)), hashed).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories and owners of every candidate of the corpus."""
    values = found.select("owner", "doc_id", "text_key", F.explode(F.array_distinct("spans.hash")).alias("hash"))
    # a repository is a document: rows of equal id and text are one, under however many owners
    by_repository = values.groupBy("hash", "doc_id", "text_key", "owner").agg(F.lit(1).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = by_repository.select("hash", "doc_id", "text_key").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "hash")


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, text_key and spans (start, kind, end, hash, repositories, owners, live) of each document; a document is a repository."""
    found = Scratch(docs.sparkSession, "secrets").table(scanned(docs, owner), "found")
    some = F.size("spans") > 0
    each = found.where(some).select("row", F.explode("spans").alias("s")).select("row", "s.*").join(ownership(found), "hash")
    live = F.col("random") & (F.least("owners", "repositories") < WIDE_OWNERS)
    span = F.struct("start", "kind", "end", "hash", "repositories", "owners", live.alias("live"))
    judged = each.groupBy("row").agg(F.collect_list(span).alias("all"))
    kept = F.filter(F.array_sort("all"), lambda s: (s["kind"] < 3) | s["live"])
    full = found.where(some).select("row", "doc_id", "text_key").join(judged, "row").select("doc_id", "text_key", kept.alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string,repositories:bigint,owners:bigint,live:boolean>>")
    return full.unionByName(found.where(~some).select("doc_id", "text_key", none.alias("spans")))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, owner: str = "source") -> DataFrame:
    """Counts and digests of the spans of each document."""
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    return scan(docs, owner).select(
        "doc_id", *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: F.least(s["owners"], s["repositories"]) >= WIDE_OWNERS).alias("n_examples"),
    )


def redacted(docs: DataFrame, owner: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with the live spans of their texts replaced by a mark; no row goes."""
    doc_id, key, spans = (free_name(x, docs.columns) for x in ("_doc_id", "_text_key", "_spans"))
    live = scan(docs, owner).select("doc_id", "text_key", F.filter("spans", lambda s: s["live"]).alias(spans)).where(F.size(spans) > 0)
    by_text = live.dropDuplicates(["doc_id", "text_key"]).withColumnsRenamed({"doc_id": doc_id, "text_key": key})
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        # a span that begins inside the one before only moves the end
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(new).alias("out"))

    clean = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(key))
    return docs.join(by_text, same, "left").withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(clean)).select(*docs.columns)
