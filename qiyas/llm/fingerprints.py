"""Canonical exact digests of texts, on built-in functions alone.

The canonical form of a text is NFKC of its full case folding of its NFKC, every run
of white space one space, none at the ends. Two 64-bit xxhashes of the form make a
fingerprint of 32 hex digits. Inside a bucket of equal hashes the canonical bytes are
compared: where they differ, all forms but the first in byte order get their number as
a suffix, so fingerprints are equal exactly where canonical forms are.

Defined results: null text is empty; rows without doc_id come first in the order of
documents; rows of equal doc_id are in the order of their texts; repeated rows give
repeated rows; with one row, the next document is that row itself; extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qiyas.llm.scratch import Scratch

#: Bits of the bitmaps that tell which rows need a comparison of bytes: 1 MB.
BITS = 23
#: Quantiles of doc_id that are taken, and rows that a block of consecutive ids holds about.
COARSE, BLOCK_ROWS = 64, 256


def canonical(text: Column) -> Column:
    """The canonical form of a text that isn't null."""
    nfkc = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return F.trim(F.regexp_replace(nfkc(fold(nfkc(text))), r"[\s\p{Z}\x{85}]+", " "))


def wide_hash(form: Column, bits: int = 64) -> Column:
    """(h1, h2) of a canonical form; fewer bits make tests of equal hashes possible."""
    cut = lambda c: c if bits == 64 else F.shiftrightunsigned(c, 64 - bits)
    return F.struct(cut(F.xxhash64(form)).alias("h1"), cut(F.xxhash64(F.lit("second"), form, F.length(form))).alias("h2"))


def in_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """Adds block, which ascends with doc_id and holds about BLOCK_ROWS rows, and the blocks of each coarse interval.

    The intervals lie between quantiles of doc_id; each is cut evenly by value.
    """
    at = [k / COARSE for k in range(1, COARSE)]
    n, low, high, inner = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", at, 10000)).first()
    if low is None:
        return docs.withColumn("block", F.lit(0).cast("long")), 1
    edges = sorted({low, *inner, high + 1})
    parts = max(1, math.ceil(n / (len(edges) - 1) / BLOCK_ROWS))
    array = F.array(*map(F.lit, edges))
    coarse = F.size(F.filter(array, lambda e: e <= F.col("doc_id")))  # 1 for the first interval
    first, after = F.element_at(array, coarse), F.element_at(array, coarse + 1)
    within = F.floor((F.col("doc_id") - first).cast("double") * parts / (after - first).cast("double"))
    block = (coarse - 1) * parts + F.least(within, F.lit(parts - 1))
    return docs.withColumn("block", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(block).cast("long")), parts


def with_next(rows: DataFrame, parts: int, columns: list[str], add: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds next_<column>: the column of the next row by doc_id, then text; the last row's next is the first.

    Within a block a window looks ahead; a block's last row takes the first row of the next block that has rows.
    add makes further columns of a row.
    """
    w = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    first = add(rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")).select("block", F.struct(*columns).alias("_first"))
    blocks, rows = rows, add(rows)
    looked = rows.withColumn("_next", F.lead(F.struct(*columns)).over(w))
    coarse = F.floor(F.col("block") / parts)
    there = blocks.groupBy("block").agg(F.count("*").alias("_rows")).withColumn("_coarse", coarse)
    inside = there.withColumn("_after", F.lead("block").over(Window.partitionBy("_coarse").orderBy("block")))
    # one row for each coarse interval, COARSE at most
    starts = there.groupBy("_coarse").agg(F.min("block").alias("_start"))
    around = Window.orderBy("_coarse")
    ahead = starts.select("_coarse", F.coalesce(F.lead("_start").over(around), F.min("_start").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_ahead"))
    before = inside.join(F.broadcast(ahead), "_coarse").select(F.col("block").alias("_before"), F.coalesce("_after", "_ahead").alias("block"))
    carried = before.join(first, "block").select(F.col("_before").alias("block"), "_first")
    found = looked.join(carried, "block", "left").withColumn("_next", F.coalesce("_next", "_first"))
    return found.select(*rows.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def bitmap(slots: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """2**BITS bits, on for each value of slot: rows of group and bits, at most 2**BITS / 32768 of 4 kB."""
    groups = slots.select(F.bitmap_bucket_number("slot").alias("_group"), F.bitmap_bit_position("slot").alias("p"))
    return scratch.table(groups.groupBy("_group").agg(F.bitmap_construct_agg("p").alias("_bits")), name)


def slot(*keys: str | Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - BITS) + 1


def those_in(rows: DataFrame, bits: DataFrame, at: Column) -> DataFrame:
    """The rows whose slot is on."""
    p = F.col("_position")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.call_function("shiftright", byte, (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    placed = rows.withColumns({"_group": F.bitmap_bucket_number(at), "_position": F.bitmap_bit_position(at)})
    return placed.join(F.broadcast(bits), "_group").where(on).select(*rows.columns)


def hexed(h: str, suffix: Column) -> Column:
    wide = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"{h}.{k}"))), 16, "0") for k in ("h1", "h2")])
    return F.concat(wide, F.when(suffix > 0, F.concat(F.lit("-"), suffix.cast("string"))).otherwise(F.lit("")))


def forms(docs: DataFrame, thin: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """keys, kind and canonical form of the rows of thin whose bucket may hold more than one row."""
    members = thin.select("h").union(thin.select(F.col("e").alias("h")))
    shared = members.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1")
    often = bitmap(shared.select(slot("h").alias("slot")), scratch, "often")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("raw"))
    formed = texts.withColumn("form", canonical(F.col("text"))).withColumn("h", wide_hash(F.col("form"), bits))
    form = those_in(formed, often, slot("h")).select("doc_id", "raw", F.lit(None).cast("long").alias("next_doc_id"), F.lit(None).cast("long").alias("next_raw"), F.lit("text").alias("kind"), "h", "form")
    edits = those_in(thin, often, slot("e")).select("doc_id", "raw", "next_doc_id", "next_raw", "e").distinct()
    # texts of which an edited text is made: few, so they're found by a bitmap before any of them moves
    wanted = bitmap(edits.select(slot("doc_id", "raw").alias("slot")).union(edits.select(slot("next_doc_id", "next_raw").alias("slot"))), scratch, "wanted")
    found = those_in(texts, wanted, slot("doc_id", "raw")).dropDuplicates(["doc_id", "raw"])
    null_safe = lambda a, b: a.eqNullSafe(b)
    a, b = found.alias("a"), found.alias("b")
    both = edits.alias("x").join(a, null_safe(F.col("x.doc_id"), F.col("a.doc_id")) & (F.col("x.raw") == F.col("a.raw"))).join(b, null_safe(F.col("x.next_doc_id"), F.col("b.doc_id")) & (F.col("x.next_raw") == F.col("b.raw")))
    edited_form = canonical(edited(F.col("a.text"), F.col("b.text")))
    of_edits = both.select("x.doc_id", "x.raw", "x.next_doc_id", "x.next_raw", F.lit("edited").alias("kind"), F.col("x.e").alias("h"), edited_form.alias("form"))
    return form.union(of_edits)


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def numbered(compared: DataFrame) -> DataFrame:
    """h, form and number of the forms of each bucket in which the bytes differ, in byte order from 0."""
    each = compared.groupBy("h", "form").agg(F.count("*").alias("_n"))
    apart = each.groupBy("h").agg(F.count("*").alias("_forms")).where("_forms > 1")
    # a bucket of unequal forms holds as many rows as there are texts with the same 128 bits of hash
    number = F.row_number().over(Window.partitionBy("h").orderBy(F.encode("form", "utf-8"))) - 1
    return each.join(apart, "h").select("h", "form", number.alias("number"))


def fingerprinted(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document.

    An exact digest's likeness is 1 where fingerprints are equal, else 0.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, parts = in_blocks(docs)
    add = lambda df: df.withColumn("raw", F.xxhash64("text")).withColumn("h", wide_hash(canonical(F.col("text")), bits))
    paired = with_next(rows, parts, ["doc_id", "raw", "text", "h"], add)
    made = paired.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    thin = made.select("doc_id", "raw", "next_doc_id", "next_raw", "h", "next_h", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), wide_hash(canonical(F.col("edited")), bits).alias("e"))
    scratch = Scratch(docs.sparkSession, "fingerprints")
    thin = scratch.table(thin, "thin")
    compared = scratch.table(forms(docs, thin, bits, scratch), "forms")
    apart = scratch.table(numbered(compared), "apart")
    zero = F.lit(0)
    suffix = {"text": zero, "edited": zero, "next": zero}
    if not apart.isEmpty():
        named = compared.join(apart, ["h", "form"]).select("doc_id", "raw", "next_doc_id", "next_raw", "kind", "number").distinct()
        keys = {"text": ("text", ["doc_id", "raw"]), "edited": ("edited", ["doc_id", "raw", "next_doc_id", "next_raw"]), "next": ("text", ["next_doc_id", "next_raw"])}
        for name, (kind, on) in keys.items():
            own = ["doc_id", "raw", "next_doc_id", "next_raw"][: len(on)]
            side = named.where(F.col("kind") == kind).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(own)], F.col("number").alias(f"_{name}"))
            same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(on)])
            thin = thin.join(side, same, "left").drop(*[f"_{i}" for i in range(len(on))])
            suffix[name] = F.coalesce(f"_{name}", zero)
    mine, its, other = hexed("h", suffix["text"]), hexed("e", suffix["edited"]), hexed("next_h", suffix["next"])
    return thin.select(
        "doc_id", "n_chars", "edited_sha256", mine.alias("fingerprint"), its.alias("edited_fingerprint"),
        (mine == its).cast("double").alias("near_edited"), (mine == other).cast("double").alias("near_next"),
    )
