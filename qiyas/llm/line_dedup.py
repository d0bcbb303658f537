"""Line dedup by a deletion-neighbourhood join.

A line is a stretch between line feeds. Its form has lower case and single spaces. A
line goes if an earlier line's form is equal, or, where both forms have ``LEAST_NEAR``
code points or more, lies within one edit of it (a code point inserted, deleted or
replaced). Earlier means by doc_id, then by line. Lines with an empty form stay.

Two forms within one edit share a deletion variant. Of equal length, they agree but
for position i, and share (i, the form without its i-th code point); else the shorter
one is the longer one without some code point. So forms emit their variants as hashed
keys of 128 bits, and equal keys meet in an aggregate that finds the earliest holder:
in a group of the first kind every two forms are within one edit, in one of the second
kind all are within one edit of the shorter form, so no pairs need be listed. Each
holder is then verified against the earliest by edit distance, and goes if it is later.

An exact step spares most variants: forms within one edit agree on the first or on the
last half of the shorter one. Only forms that share such a half with another form emit
variants, and only those that delete outside it.

Defined results: null text has no lines and stays null; null doc_id counts as the
smallest; rows of equal doc_id and unequal texts are ordered by line, then by a hash of
the text; rows of equal doc_id and text count as one and keep the same lines; extra
columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qiyas.llm import textbuf as tb
from qiyas.llm.bitmaps import Member, broadcast_bitmap
from qiyas.llm.scratch import Scratch, free_name

#: Code points that a form needs to be matched with one edit; shorter ones must be equal.
LEAST_NEAR = 20


#: 64-bit codes of the code points below 2**16, for each lane of the hashes.
CODES = [tb.mix(np.arange(1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(lane + 1)) for lane in (0, 1)]
BASES = (tb.BASE, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def form(line: str) -> str:
    return " ".join(line.lower().split())


def coded(points: np.ndarray, lane: int) -> np.ndarray:
    if len(points) and points.max() >> 16:
        return np.where(points >> 16 == 0, CODES[lane][points & 0xFFFF], tb.mix(points.astype(np.uint64) * np.uint64(2) + np.uint64(lane + 1)))
    return CODES[lane][points]


class Lines:
    """The lines of a slice of documents, with hashes of the parts of their forms, in one or two lanes of 64 bits."""

    def __init__(self, batch: pa.RecordBatch, lanes: int = 1):
        rows, numbers, forms = [], [], []
        for i, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
            if text.is_valid:
                for k, line in enumerate(text.as_py().lower().split("\n")):
                    if f := " ".join(line.split()):
                        rows.append(i)
                        numbers.append(k)
                        forms.append(f)
        self.rows, self.numbers, self.forms = np.array(rows, np.int64), np.array(numbers, np.int32), forms
        points = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lanes = range(lanes)
        self.at = np.concatenate([[0], np.cumsum([len(f) for f in forms], dtype=np.int64)]).astype(np.int64)
        self.length = np.diff(self.at)
        self.up, self.down, self.sums = [], [], []
        for lane in self.lanes:
            self.up.append(tb.powers(len(points) + 1, BASES[lane]))
            self.down.append(tb.powers(len(points) + 1, INVERSES[lane]))
            s = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(coded(points, lane) * self.up[lane][:-1], out=s[1:])
            self.sums.append(s)
        self.first = np.zeros(len(forms), bool)  # of equal forms in this slice, the earliest, or the first row's without ids
        if forms:
            order = self._order(batch)
            self.first[order[np.unique(self.hashes(self.at[:-1], self.at[1:])[0][order], return_index=True)[1]]] = True

    def _order(self, batch: pa.RecordBatch) -> np.ndarray:
        """The lines by (doc_id, line, tie), null ids before others; as they stand where the slice has no ids."""
        if "doc_id" not in batch.schema.names:
            return np.arange(len(self.rows))
        doc_id, tie = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tie"))
        known = np.asarray(doc_id.is_valid())
        ids = np.asarray(doc_id.cast(pa.int64()).fill_null(0))
        return np.lexsort((np.asarray(tie)[self.rows], self.numbers, ids[self.rows], known[self.rows]))

    def _raw(self, lane: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[lane][b] - self.sums[lane][a]) * self.down[lane][a]

    def hashes(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray | int = 0) -> tuple[np.ndarray, ...]:
        """The lanes of the hash of code points [a, b)."""
        return self._final([self._raw(k, a, b) for k in self.lanes], b - a, salt)

    def variants(self, line: np.ndarray, i: np.ndarray, salt: np.ndarray | int) -> tuple[np.ndarray, ...]:
        """The lanes of the hash of a line's form without its i-th code point."""
        a, b = self.at[line], self.at[line + 1]
        joined = [self._raw(k, a, a + i) + self._raw(k, a + i + 1, b) * self.up[k][i] for k in self.lanes]
        return self._final(joined, b - a - 1, salt)

    @staticmethod
    def _final(raw: list[np.ndarray], length: np.ndarray, salt: np.ndarray | int) -> tuple[np.ndarray, ...]:
        more = length.astype(np.uint64) + (np.asarray(salt).astype(np.uint64) << np.uint64(32))
        return tuple(tb.mix(tb.mix(raw[k]) + tb.mix(more + np.uint64(k))).view(np.int64) for k in range(len(raw)))

    def half_keys(self) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(shorter by, side) to the lines, keys and the length of the half, for the slice's distinct long forms.

        shorter by 0 meets forms of equal length, 1 and -1 meet forms one code point shorter and longer.
        """
        out = {}
        line = np.flatnonzero(self.first & (self.length >= LEAST_NEAR))
        a, b, n = self.at[line], self.at[line + 1], self.length[line]
        for shorter in (0, 1):
            m = (n - shorter) // 2
            for side in (0, 1):
                span = (a, a + m) if side == 0 else (b - m, b)
                # the number of code points of the shorter form is part of the key
                key = self.hashes(*span, salt=((n - shorter) * 2 + side + 1).astype(np.int64))[0]
                out[shorter, side] = line, key, m
        return out

    def near(self, halves: Member) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
        """(kind, lines, positions, keys) of the variants: kind 1 replaces, kind 2 deletes."""
        found = self.half_keys()
        for shorter in (0, 1):
            line, key, m = found[shorter, 0]
            head, tail = halves(key), halves(found[shorter, 1][1])
            n = self.length[line]
            # a shared first half leaves positions m to n - 1, a shared last half 0 to n - m - 1
            low, high = np.where(tail, 0, m), np.where(head, n, n - m)
            use = (head | tail) & (n - shorter >= LEAST_NEAR)
            line, low, count = line[use], low[use], (high - low)[use]
            of = np.repeat(np.arange(len(line)), count)
            i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[of]
            yield 1 + shorter, line[of], i, self.variants(line[of], i, salt=0 if shorter else i + 1)


def half_rows(docs: DataFrame) -> DataFrame:
    """key and form hash of every half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            x = Lines(batch)
            whole = x.hashes(x.at[:-1], x.at[1:])[0]
            got = list(x.half_keys().values())
            keys, forms = np.concatenate([k for _, k, _ in got]), np.concatenate([whole[line] for line, _, _ in got])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(forms)], ["key", "form"])

    return docs.select("text").mapInArrow(run, "key long, form long")


def variant_rows(docs: DataFrame, halves) -> DataFrame:
    """key and form hash of every variant, and of the forms that may be a variant of another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = Member(halves)
        for batch in tb.slices(batches):
            x = Lines(batch)
            whole = x.hashes(x.at[:-1], x.at[1:])[0]
            keys, forms = [], []
            for _, line, _, key in x.near(member):
                keys.append(key[0])
                forms.append(whole[line])
            line, key, _ = x.half_keys()[0, 0]  # a shorter form shares a half with the longer one
            shared = line[member(key) | member(x.half_keys()[0, 1][1])]
            keys.append(whole[shared])
            forms.append(whole[shared])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(forms))], ["key", "form"])

    return docs.select("text").mapInArrow(run, "key long, form long")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Keys that two forms hold."""
    return rows.groupBy("key").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a != b").select("key")


HOLDERS = "k1 long, k2 long, kind int, doc_id long, tie long, line int, form string"


def holder_rows(docs: DataFrame, halves, variants) -> DataFrame:
    """Every line under the key of its form (kind 0), and variants whose key may be shared (1: replaced, 2: deleted).

    The form itself goes along where it may have to be verified.
    """
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, shared = Member(halves), Member(variants)
        for batch in tb.slices(batches):
            x = Lines(batch, 2)
            doc_id, tie = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tie"))
            w1, w2 = x.hashes(x.at[:-1], x.at[1:])
            forms = np.array(x.forms, object)
            hit = shared(w1) & x.first
            parts = [(w1, w2, np.zeros(len(w1), np.int32), np.arange(len(w1)), np.where(hit, forms, None) if len(forms) else forms)]
            for kind, line, _, (v1, v2) in x.near(near):
                use = shared(v1)
                line = line[use]
                parts.append((v1[use], v2[use], np.full(len(line), kind, np.int32), line, forms[line]))
            line = np.concatenate([p[3] for p in parts])
            row = pa.array(x.rows[line])
            cols = [np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), doc_id.take(row), tie.take(row), x.numbers[line], np.concatenate([p[4] for p in parts])]
            yield pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t, from_pandas=True) for c, t in zip(cols, types, strict=True)], [f.split()[0] for f in HOLDERS.split(", ")])

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(run, HOLDERS)


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text) and lines (ascending numbers from 0) of the lines that go."""
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.select("doc_id", "text")
    halves = broadcast_bitmap(shared_keys(half_rows(docs)))
    variants = broadcast_bitmap(shared_keys(variant_rows(docs, halves)))
    rows = scratch.table(holder_rows(docs, halves, variants), "holders")
    # null doc_id comes first in the order of structs
    at = F.struct("doc_id", "line", "tie")
    line, variant = F.col("kind") == 0, F.col("kind") > 0
    firsts = rows.withColumn("at", at).groupBy("k1", "k2").agg(
        F.min(F.when(line, F.col("at"))).alias("first_line"),
        F.min(F.when(line & F.col("form").isNotNull(), F.struct("at", "form"))).alias("first_form"),
        F.min(F.when(variant, F.struct("at", "form"))).alias("first_variant"),
        F.count("*").alias("n"),
    ).where("n > 1").drop("n")
    both = rows.withColumn("at", at).join(firsts, ["k1", "k2"])
    within = lambda other: F.levenshtein(F.col("form"), other["form"]) <= 1
    later = lambda other: other["at"] < F.col("at")
    same = line & (F.col("first_line") < F.col("at"))
    longer_first = line & F.col("form").isNotNull() & later(F.col("first_variant")) & within(F.col("first_variant"))
    replaced = (F.col("kind") == 1) & later(F.col("first_variant")) & within(F.col("first_variant"))
    shorter_first = (F.col("kind") == 2) & later(F.col("first_form")) & within(F.col("first_form"))
    gone = both.where(same | longer_first | replaced | shorter_first)
    return gone.groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def deduplicated(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the kept lines of each text, and the numbers of lines and of removed ones, named by ``counts``, after the other columns.

    A column of docs that has one of these names is left out.
    """
    names = [c for c in docs.columns if c.lower() not in {x.lower() for x in counts}]
    docs = docs.select(*[docs[c] for c in names])
    doc_id, tie, lines = (free_name(x, names) for x in ("_doc_id", "_tie", "_lines"))
    gone = removed_lines(docs).withColumnsRenamed({"doc_id": doc_id, "tie": tie, "lines": lines})
    same = docs["doc_id"].eqNullSafe(gone[doc_id]) & (F.xxhash64(docs["text"]) == gone[tie])
    joined = docs.join(gone, same, "left").select(*[docs[c] for c in names], lines)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{counts[0]}` long, `{counts[1]}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, gone in zip(batch.column(names.index("text")), batch.column(len(names)), strict=True):
                text, gone = text.as_py(), set(gone.as_py() or ())
                parts = [] if text is None else text.split("\n")
                texts.append(text if not gone else "\n".join(x for k, x in enumerate(parts) if k not in gone))
                lines.append(len(parts))
                removed.append(len(gone))
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*names, *counts])

    return joined.mapInArrow(run, schema)
