"""How the sources of a language differ in their terms.

A term is a run of letters A-Z, taken in lower case, and characters from U+0080 on. A language keeps the
V terms that at least ``LEAST_DOCS`` of its documents hold. A group is a (language, source), also one without terms.
A group with N kept occurrences gives a term that it holds ``count`` times the share
p = 1 + floor(UNIT * (count + 1) / (N + V)); the language as a whole likewise. Two shares p and q are apart by
f = floor((p - q)^2 / q). All arithmetic is exact: shares by long division in steps that fit 64 bits.

Two parts:

- pair: for each two sources of a language the sum of f over all kept terms. Most terms are in few of the sources, so nothing
  is added up term by term for pairs that lack it. With z for the share of a count of 0, the sum is V * f(z, z)
  + the sum over the first's terms of f(p, z) - f(z, z) + the same for the second's + a correction for terms that both hold. The middle
  parts need only how many terms a source holds how often; only the correction meets pairs, per term those that hold it.
- term: for each group the ``TOP`` terms with p above the language's share, by f. The kth value is found by radix selection:
  histograms over 15 bits of the values at a time, from the highest, give the bin in which each group's kth value lies, until
  all bits are known; rows of that value are then ordered by their UTF-8 bytes, two at a time, in the same way. No group is sorted.

Texts are cut to terms and counted in Arrow batches; the rest is shuffles of counts. A term's pairs are made in blocks of
``BLOCK`` of its sources, dealt to many tasks, so a term that every source holds isn't one task's work.

Defined results: null text, language or source counts as ''; each row is a document, repeated ids too; a language without
kept terms has V = 0 and all its pairs are 0; equal values rank by UTF-8 bytes; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qiyas.llm import textbuf as tb
from qiyas.llm.scratch import Scratch

UNIT, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Sources of a term in a block of its pairs; pairs made at a time; bytes of text counted at a time; bits of a digit.
BLOCK, PAIRS, COUNTED_BYTES, DIGIT = 512, 1 << 20, 8 << 20, 15
COUNTS = "lang string, source string, term string, count long, docs long"
PARTIAL = "lang string, a string, b string, value long"


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each (lang, source, term) of some rows: occurrences and documents."""
    raw, at = tb.utf8(batch.column(2))
    low = tb.lower(raw)
    solid = ((low >= 97) & (low <= 122)) | (low >= 128)
    # words of textbuf.ascii_words with every byte outside of a term as white space
    starts, ends, of = tb.ascii_words(np.where(solid, low, np.uint8(32)), at)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(low[solid].tobytes())).dictionary_encode()
    group = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["l", "s"])
    keys = {}
    of_row = np.array([keys.setdefault((g["l"], g["s"]), len(keys)) for g in group.to_pylist()], np.int64)
    n = max(len(terms.dictionary), 1)
    in_doc, times = np.unique(of * n + terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
    cell, back = np.unique(of_row[in_doc // n] * n + in_doc % n, return_inverse=True)
    count = np.zeros(len(cell), np.int64)
    np.add.at(count, back, times)
    docs = np.bincount(back, minlength=len(cell)).astype(np.int64)
    names = list(keys)
    of_group = pa.array(cell // n)
    lang, source = (pa.array([g[k] for g in names], pa.string()).take(of_group) for k in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, terms.dictionary.take(pa.array(cell % n)).cast(pa.string()), pa.array(count), pa.array(docs)], ["lang", "source", "term", "count", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count and docs (that hold it) of rows with lang, source and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, limit=COUNTED_BYTES):
            yield _counted(batch)

    text = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return text.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total) in three steps of a long division, exact for totals up to 2**53."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        step = rest * 1000
        out, rest = out * 1000 + _div(step, total), step % total
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def apart(p: Column, q: Column) -> Column:
    """f(p, q)."""
    return _div((p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _corrections(batch: pa.RecordBatch, width: int, most: int) -> pa.RecordBatch:
    """The sums over terms of f(p, q) - f(p, z) - f(z, q) + f(z, z) for the ordered pairs of sources in each row's block.

    A row has lang, cells(source, p, z) and the number of its block, whose ``width`` sources come first in a pair; about ``most`` pairs are made at a time.
    """
    langs = batch.column(0).dictionary_encode()
    cells, block = batch.column(1), batch.column(2).to_numpy()
    ends = cells.offsets.to_numpy().astype(np.int64)
    begin, end = ends[:-1], ends[1:]
    flat = cells.values
    names = flat.field("source").dictionary_encode()
    source = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    p, z = flat.field("p").to_numpy(), flat.field("z").to_numpy()
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = max(len(names.dictionary), 1)
    first = begin + block * width
    rows = np.minimum(end - first, width)  # sources that come first
    work = rows * (end - begin)
    sums: dict[int, int] = {}
    cut = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum(work) // most])))
    for part in np.split(np.arange(len(work)), cut):
        if not len(part):
            continue
        r = np.repeat(part, rows[part])
        i = np.repeat(first[part] - (np.cumsum(rows[part]) - rows[part]), rows[part]) + np.arange(int(rows[part].sum()))
        wide = (end - begin)[r]
        a = np.repeat(i, wide)
        b = np.repeat(begin[r] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
        apart_ = a != b
        key = (np.repeat(lang[r], wide)[apart_] * n + source[a[apart_]]) * n + source[b[apart_]]
        a, b = a[apart_], b[apart_]
        value = _f(p[a], p[b]) - _f(p[a], z[b]) - _f(z[a], p[b]) + _f(z[a], z[b])
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        new = np.flatnonzero(np.diff(np.concatenate([[-1], key])))
        if len(new):
            for k, v in zip(key[new].tolist(), np.add.reduceat(value, new).tolist(), strict=True):
                sums[k] = sums.get(k, 0) + v
    keys = np.fromiter(sums, np.int64, len(sums))
    name = names.dictionary.cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.cast(pa.string()).take(pa.array(keys // (n * n))), name.take(pa.array(keys // n % n)), name.take(pa.array(keys % n)), pa.array(list(sums.values()), pa.int64())],
        ["lang", "a", "b", "value"],
    )


def pairs(kept: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, a, b and value for each two sources of a language. kept: lang, source, term, count, p, z. groups: lang, source, vocabulary, z."""
    cells = kept.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("cells"))
    terms = scratch.table(cells.withColumn("n", F.size("cells")).where("n > 1").select("lang", "cells", "n"), "terms")
    few = terms.where(F.col("n") <= BLOCK).select("lang", "cells", F.lit(0).alias("block"))
    many = terms.where(F.col("n") > BLOCK).select("lang", "cells", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / BLOCK).cast("int"))).alias("block"))
    many = many.repartition(F.xxhash64("block", "cells"))
    width, most = BLOCK, PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _corrections(batch, width, most)
        tb.release()

    both = few.union(many).mapInArrow(run, PARTIAL)
    held = kept.groupBy("lang", "source", "count", "p", "z").agg(F.count("*").alias("terms"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("w"))
    met = held.join(other, "lang").where(F.col("source") != F.col("other"))
    base = apart(F.col("z"), F.col("w"))
    one = met.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), (F.col("terms") * (apart(F.col("p"), F.col("w")) - base)).alias("value"))
    turned = apart(F.col("w"), F.col("z"))
    two = met.select("lang", F.col("other").alias("a"), F.col("source").alias("b"), (F.col("terms") * (apart(F.col("w"), F.col("p")) - turned)).alias("value"))
    zero = groups.join(other, "lang").where(F.col("source") != F.col("other"))
    none = zero.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.when(F.col("vocabulary") > 0, F.col("vocabulary") * base).otherwise(0).alias("value"))
    return both.union(one).union(two).union(none).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _bytes(item: str) -> Column:
    """A string that sorts as the item's UTF-8 bytes do; its end sorts before all digits."""
    return F.concat(F.hex(F.encode(item, "utf-8")), F.lit("!"))


def _narrowed(rows: DataFrame, state: DataFrame, key: list[str], digit: Column, descending: bool) -> DataFrame:
    """state's next digit: in each group's bins, in order, the first at which ``need`` rows are reached, and what is still needed from it.

    rows hold only those of the bin found so far. A group of fewer rows than needed has none left to find.
    """
    bins = rows.groupBy(*key, digit.alias("digit")).agg(F.count("*").alias("n")).join(state.select(*key, "need"), key)
    order = F.desc("digit") if descending else F.asc("digit")
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = bins.withColumn("upto", F.sum("n").over(w)).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    return run.select(*key, "digit", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), F.col("n").alias("bin"))


def top(rows: DataFrame, key: list[str], value: str, item: str, k: int, scratch: Scratch, bits: int = 60) -> DataFrame:
    """The k rows of each group with the largest value (0 <= value < 2**bits), equal values by the item's UTF-8 bytes, with their rank.

    rows must be a written table with distinct items in a group.
    """
    state = rows.groupBy(*key).agg(F.count("*").alias("bin")).where(F.col("bin") > k).select(*key, F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("bound"), "bin")
    step = 0
    for shift in range(bits - DIGIT, -1, -DIGIT):
        state = scratch.table(state, f"bits{step}")
        step += 1
        open_ = rows.join(state.drop("bin"), key).where(F.shiftright(value, shift + DIGIT) == F.col("bound"))
        found = _narrowed(open_, state, key, F.shiftright(value, shift).bitwiseAND((1 << DIGIT) - 1), True)
        state = found.join(state.select(*key, "bound"), key).select(*key, "need", (F.shiftleft("bound", DIGIT) + F.col("digit")).alias("bound"), "bin")
    limits = scratch.table(state, "values")  # need: how many rows of the value bound; bin: how many there are
    tied = rows.join(limits.where("bin > need").select(*key, "bound"), key).where(F.col(value) == F.col("bound")).select(*key, _bytes(item).alias("_hex"))
    tied = scratch.table(tied, "tied")
    state = limits.where("bin > need").select(*key, "need", F.lit("").alias("prefix"), "bin")
    ends = []
    while True:
        state = scratch.table(state, f"ties{step}")
        ends.append(state.where("bin = need").select(*key, "prefix"))
        state = state.where("bin > need")
        if state.isEmpty():
            break
        open_ = tied.join(state.select(*key, "prefix"), key).where(F.startswith("_hex", "prefix"))
        # what all rows of the bin begin with is no choice, so it is skipped
        extent = open_.groupBy(*key).agg(F.min("_hex").alias("lo"), F.max("_hex").alias("hi"), F.first("prefix").alias("prefix"))
        differ = F.array_position(F.zip_with(F.split("lo", ""), F.split("hi", ""), lambda x, y: x.eqNullSafe(y)), False)
        common = extent.select(*key, F.substring("lo", F.lit(1), ((differ - 1) / 2).cast("int") * 2).alias("prefix"))
        open_ = open_.drop("prefix").join(common, key)
        found = _narrowed(open_, state, key, F.substring("_hex", F.length("prefix") + 1, F.lit(4)), False)
        state = found.join(common, key).select(*key, "need", F.concat("prefix", "digit").alias("prefix"), "bin")
        step += 1
    prefix = ends[0]
    for e in ends[1:]:
        prefix = prefix.union(e)
    last = limits.select(*key, "bound").join(prefix, key, "left")
    within = (F.col(value) > F.col("bound")) | ((F.col(value) == F.col("bound")) & (F.col("prefix").isNull() | (F.substring(_bytes(item), F.lit(1), F.length("prefix")) <= F.col("prefix"))))
    chosen = rows.join(last, key, "left").where(F.col("bound").isNull() | within)
    # k rows of a group at most
    return chosen.select(*rows.columns, F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(value), item)).alias("rank"))


def audited(docs: DataFrame, top_terms: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: both parts for every group."""
    scratch = Scratch(docs.sparkSession, "divergence")
    w = Window.partitionBy("lang", "term")  # a row a source
    held = counts(docs).withColumns({"_docs": F.sum("docs").over(w), "all": F.sum("count").over(w)}).where(F.col("_docs") >= LEAST_DOCS)
    held = scratch.table(held.select("lang", "source", "term", "count", "all"), "held")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    total = held.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    vocabulary = held.groupBy("lang").agg(F.count_distinct("term").alias("vocabulary"), F.sum("count").alias("words"))
    groups = docs.select(*blank).distinct().join(total, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["n", "vocabulary", "words"])
    size, whole = F.greatest(F.col("n") + F.col("vocabulary"), F.lit(1)), F.col("words") + F.col("vocabulary")
    groups = scratch.table(groups.select("lang", "source", "vocabulary", size.alias("size"), whole.alias("whole"), share(F.lit(0).cast("long"), size).alias("z")), "groups")
    kept = held.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("size")))
    kept = scratch.table(kept.withColumn("q", share(F.col("all"), F.col("whole"))).select("lang", "source", "term", "count", "p", "q", "z"), "kept")
    over = scratch.table(kept.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")), "over")
    terms = top(over, ["lang", "source"], "value", "item", top_terms, scratch)
    apart_ = pairs(kept, groups, scratch).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # a row a source of the language
    apart_ = apart_.withColumn("rank", F.row_number().over(by_value))
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return apart_.select(*columns("pair")).union(terms.select(*columns("term")))
