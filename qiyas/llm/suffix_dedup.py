"""Removal of repeated byte strings by multi-document suffix sorting, column by column.

A byte goes if a string of ``WINDOW`` bytes covers it that also starts earlier: in a
document of smaller doc_id, or earlier in the same one. Strings are judged on the input
and do not cross documents.

A window's anchor is the leftmost of the least hashes of its ``GRAM``-byte strings, so
equal windows have equal anchors at equal distance. The windows of one anchor are
consecutive; together they are a segment of less than 2 * WINDOW bytes. Equal windows lie
in segments of equal anchor hash, so the corpus falls apart into groups of short segments.
Equal segments are one row, the earliest: all windows of the others go. Runs of some
consecutive segments, cut where an anchor's hash says so, are compared first, so copies of
long passages are one row for many segments, and only anchors found in unequal runs
go on. Where a group
holds unequal segments, the collection's Burrows-Wheeler transform decides: it is built
one column after another from the right, every round inserting one symbol of each
segment and updating the common prefixes of neighbours, in sequential files that are
read and written once a round (``Collection``). Windows that are neighbours with a common
prefix of WINDOW bytes are equal, and all but the earliest go.

(Whole documents as the collection's members would need as many rounds over all the data as
the longest document has bytes; segments need less than 2 * WINDOW.)

A group of more than ``HOT_GROUP`` unequal segments that may share a window isn't sorted by one task: its windows
meet one by one under digests of their bytes, with the same result.

Defined results: null text is empty; null doc_id counts as the smallest; rows of equal
doc_id and unequal texts are ordered by a hash of the text; rows of equal doc_id and
text count as one and keep the same bytes; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qiyas.llm import textbuf as tb
from qiyas.llm.bitmaps import Member, broadcast_bitmap
from qiyas.llm.scratch import Scratch

WINDOW, GRAM, RUN = 100, 32, 16
#: Two segments of one anchor that share a window share the anchor with k * STEP bytes before it and BESIDE - k * STEP after it, for some k.
STEP = 4
BESIDE = WINDOW - GRAM - STEP
#: Bytes of segments that one task sorts at once.
SORTED_BYTES = 6 << 20


#: Windows whose least grams are taken at once, so that the arrays in use stay in a core's cache.
BLOCK = 32 << 10


def window_least(sums: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Of each WINDOW bytes the least gram: the upper half of its hash, then its start.

    Minima of 2, 4, 8 ... neighbours are taken from each other, in two buffers by turns.
    """
    grams = WINDOW - GRAM + 1
    inverse = tb.powers(len(sums), tb.INVERSE)
    out = np.empty(max(len(sums) - WINDOW, 0), np.uint64)
    x, y = np.empty(block + grams - 1, np.uint64), np.empty(block + grams - 1, np.uint64)
    for low in range(0, len(out), block):
        n = min(block, len(out) - low)
        m = n + grams - 1
        a, b = x[:m], y[:m]
        np.subtract(sums[low + GRAM : low + GRAM + m], sums[low : low + m], out=a)
        a *= inverse[low : low + m]
        a += np.uint64(GRAM)
        tb.mix_in_place(a, b)
        a &= np.uint64(0xFFFFFFFF00000000)
        a |= np.arange(low, low + m, dtype=np.uint64)
        width = 1
        while 2 * width <= grams:
            m -= width
            np.minimum(a[:m], a[width : width + m], out=b[:m])
            a, b, width = b, a, 2 * width
        np.minimum(a[:n], a[grams - width : grams - width + n], out=out[low : low + n])
    return out


def segments(sums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, last window (starts within the flat bytes) and anchor hash of every segment; sums: prefix sums of the bytes."""
    least = window_least(sums)
    n = len(least)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    # by rows: windows that end inside, and starts whose window would not
    fit = np.maximum(np.diff(at) - (WINDOW - 1), 0)
    inside = np.repeat(np.tile([True, False], len(fit)), np.stack([fit, np.diff(at) - fit], axis=1).ravel())[:n]
    new = np.ones(n, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[at[at < n]] = True
    starts = np.flatnonzero(new & inside)
    ends = np.ones(n, bool)
    ends[:-1] = new[1:] | ~inside[1:]
    lasts = np.flatnonzero(ends & inside)
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    grams = tb.span_hashes(sums, anchor, anchor + GRAM, tb.powers(len(sums), tb.INVERSE))
    # mixed again: the least of many hashes are all small
    return np.searchsorted(at, starts, side="right") - 1, starts, lasts, tb.mix(grams).view(np.int64)


def runs(sums: np.ndarray, of: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each segment's run, and of every run its first segment, its last, and a 64-bit hash of its bytes.

    A run ends with its document or before a segment whose anchor's hash is a multiple of RUN.
    """
    n = len(first)
    new = np.ones(n, bool)
    new[1:] = (of[1:] != of[:-1]) | (anchor[1:] % RUN == 0)
    a = np.flatnonzero(new)
    b = np.append(a[1:], n) - 1 if n else a
    digest = tb.span_hashes(sums, first[a], last[b] + WINDOW, tb.powers(len(sums), tb.INVERSE)).view(np.int64) if n else np.zeros(0, np.int64)
    return np.cumsum(new) - 1, a, b, digest


def anchor_keys(docs: DataFrame) -> DataFrame:
    """key (anchor hash) and run (hash of its run's bytes) of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            raw, at = tb.utf8(batch.column(0))
            sums = tb.prefix_sums(raw)
            of, first, last, anchor = segments(sums, at)
            run_of, _, _, digest = runs(sums, of, first, last, anchor)
            # an anchor that stands again in its own run counts as one of another run
            order = np.lexsort((anchor, run_of))
            again = np.zeros(len(anchor), bool)
            again[order[1:]] = (anchor[order[1:]] == anchor[order[:-1]]) & (run_of[order[1:]] == run_of[order[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(digest[run_of] + again)], ["key", "run"])

    return docs.select("text").mapInArrow(run, "key long, run long")


def run_places(docs: DataFrame) -> DataFrame:
    """d1, d2 (digest of a run's bytes), doc_id, tie, start and stop of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            raw, at = tb.utf8(batch.column(2))
            sums = tb.prefix_sums(raw)
            of, first, last, anchor = segments(sums, at)
            _, a, b, digest = runs(sums, of, first, last, anchor)
            data = raw.tobytes()
            start, stop = first[a], last[b] + WINDOW
            second = np.array([int.from_bytes(hashlib.blake2b(data[x:y], digest_size=8).digest(), "little", signed=True) for x, y in zip(start.tolist(), stop.tolist(), strict=True)], np.int64)
            row = pa.array(of[a])
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(second), batch.column(0).take(row), batch.column(1).take(row), pa.array((start - at[of[a]]).astype(np.int32)), pa.array((stop - at[of[a]]).astype(np.int32))], ["d1", "d2", "doc_id", "tie", "start", "stop"])

    return docs.select("doc_id", "tie", "text").mapInArrow(run, "d1 long, d2 long, doc_id long, tie long, start int, stop int")


def anchor_places(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where the anchors of segments stand: the leftmost least gram of the last window."""
    if not len(first):
        return first
    inverse = tb.powers(len(sums), tb.INVERSE)
    at = last[:, None] + np.arange(WINDOW - GRAM + 1)
    grams = tb.span_hashes(sums, at, at + GRAM, inverse) >> np.uint64(32)
    return last + grams.argmin(axis=1)


def shareable(flat: np.ndarray, first: np.ndarray, end: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments that lie in flat: those that may share a window with another, and which of their bytes its windows can hold.

    place: where the anchors stand. A shared window holds, for some k, bytes around the anchor that both segments have.
    """
    sums, inverse = tb.prefix_sums(flat), tb.powers(len(flat) + 1, tb.INVERSE)
    steps = BESIDE // STEP + 1
    k, who = np.repeat(np.arange(steps), len(first)), np.tile(np.arange(len(first)), steps)
    low = place[who] - k * STEP
    use = (low >= first[who]) & (low + GRAM + BESIDE <= end[who])
    k, who, low = k[use], who[use], low[use]
    keys = tb.span_hashes(sums, low, low + GRAM + BESIDE, inverse)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    met = np.zeros((steps, len(first)), bool)
    met[k[again], who[again]] = True
    there = np.flatnonzero(met.any(axis=0))
    least, most = met[:, there].argmax(axis=0), steps - 1 - met[::-1, there].argmax(axis=0)
    before = (most + 1) * STEP
    start = np.maximum(place[there] - before, first[there])
    return there, start, np.minimum(place[there] + WINDOW - least * STEP, end[there])


PLACES = "anchor long, d1 long, doc_id long, tie long, start int, windows int, bytes binary, place int"


def places(docs: DataFrame, shared, with_bytes: bool) -> DataFrame:
    """The segments whose anchor may be in a bitmap; d1: hash of their bytes; bytes only where asked for."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = Member(shared)
        for batch in tb.slices(batches):
            raw, at = tb.utf8(batch.column(2))
            sums = tb.prefix_sums(raw)
            of, first, last, anchor = segments(sums, at)
            use = member(anchor) if len(anchor) else np.zeros(0, bool)
            of, first, last, anchor = of[use], first[use], last[use], anchor[use]
            data = raw.tobytes() if with_bytes else b""
            parts = [data[a : b + WINDOW] for a, b in zip(first.tolist(), last.tolist(), strict=True)] if with_bytes else [None] * len(first)
            digest = tb.span_hashes(sums, first, last + WINDOW, tb.powers(len(sums), tb.INVERSE)).view(np.int64)
            row = pa.array(of)
            place = (anchor_places(sums, first, last) - first).astype(np.int32) if with_bytes else np.zeros(len(first), np.int32)
            cols = [anchor, digest, batch.column(0).take(row), batch.column(1).take(row), (first - at[of]).astype(np.int32), (last - first + 1).astype(np.int32), parts, place]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.split()[0] for f in PLACES.split(", ")])

    return docs.select("doc_id", "tie", "text").mapInArrow(run, PLACES)


def range_least(x: np.ndarray, low: np.ndarray, high: np.ndarray, block: int = 256) -> np.ndarray:
    """min(x[low:high]) for each pair, low < high."""
    out = np.empty(len(low), x.dtype)
    long = high - low > 4 * block
    order = np.argsort(low, kind="stable")
    order = order[~long[order]]
    padded = np.append(x, x.dtype.type(255))
    if len(order):
        pairs = np.empty(2 * len(order), np.int64)
        pairs[::2], pairs[1::2] = low[order], high[order]
        out[order] = np.minimum.reduceat(padded, pairs)[::2]
    if long.any():
        least = np.minimum.reduceat(x, np.arange(0, len(x), block))
        a, b = low[long], high[long]
        a2, b2 = -(-a // block), b // block
        got = range_least(least, a2, b2, block)
        head = np.where(a < a2 * block, range_least(x, a, np.maximum(a2 * block, a + 1), block), 255)
        tail = np.where(b2 * block < b, range_least(x, np.minimum(b2 * block, b - 1), b, block), 255)
        out[long] = np.minimum(got, np.minimum(head, tail))
    return out


class Collection:
    """The Burrows-Wheeler transform of a collection of byte strings, and common prefixes of neighbours up to a limit.

    Symbols are bytes plus one (UTF-8 never has 255); 0 ends a string. Symbols and prefixes lie side by side in a file of
    at most twice SORTED_BYTES and a group, which every round reads from front to back and writes anew.
    """

    def __init__(self, strings: list[bytes], limit: int = WINDOW):
        self.limit, self.count = limit, len(strings)
        self.length = np.array([len(s) for s in strings], np.int64)
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.end = np.cumsum(self.length)
        with tempfile.TemporaryFile() as self.file:
            self._write(bytes(2 * self.count))
            at = np.arange(self.count)  # where each string's longest suffix so far stands
            for k in range(int(self.length.max(initial=0))):
                at = self._round(k, at)
            self.bwt, self.lcp = map(np.ascontiguousarray, self._read().T)

    def _read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(bytearray(self.file.read()), np.uint8).reshape(-1, 2)

    def _write(self, data) -> None:
        self.file.seek(0)
        self.file.write(data)

    def _round(self, k: int, at: np.ndarray) -> np.ndarray:
        """Inserts the symbol that stands k from the right of every string that has one."""
        both = self._read()
        active = np.flatnonzero(self.length > k)
        old, symbol = at[active], self.text[self.end[active] - 1 - k] + np.uint8(1)
        both[old, 0] = symbol
        bwt, lcp = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        # the i-th place in this order begins the i-th suffix; a symbol's places ascend between its edges
        order = np.argsort(bwt, kind="stable")
        edge = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=256))])
        ended = int(edge[1])
        by = np.argsort(symbol.astype(np.int64) << 40 | old)
        old, symbol = old[by], symbol[by]
        cut = np.searchsorted(symbol, np.arange(257))
        rank = np.concatenate([edge[c] + np.searchsorted(order[edge[c] : edge[c + 1]], old[cut[c] : cut[c + 1]]) for c in np.flatnonzero(np.diff(cut))])
        # suffixes whose neighbour before them is another than before: the new ones, and those after a new one
        touched = np.sort(np.concatenate([rank, rank + 1]))
        touched = touched[np.append(True, touched[1:] != touched[:-1]) & (touched < len(order))]
        alike = touched[touched > edge[np.searchsorted(edge, touched, side="right") - 1]]
        value = np.minimum(range_least(lcp, order[alike - 1] + 1, order[alike] + 1).astype(np.int64) + 1, self.limit)
        # all suffixes in their new order: those that were there keep their values unless touched
        move = self.count - ended
        target = move + rank
        places = target - np.arange(len(target))
        data, cuts = both.data.cast("B"), [0, *(2 * places).tolist(), 2 * len(bwt)]
        new = bytearray(b"\0\0").join([data[a:b] for a, b in itertools.pairwise(cuts)])
        values = np.frombuffer(new, np.uint8).reshape(-1, 2)[:, 1]
        values[move + touched] = 0
        values[move + alike] = value
        self._write(new)
        out = at + np.searchsorted(places, at, side="right")
        out[active[by]] = target
        return out

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, start and class of every suffix of ``limit`` symbols or more whose first ``limit`` occur again."""
        order = np.argsort(self.bwt, kind="stable")[int(np.count_nonzero(self.bwt == 0)) :]
        step = np.zeros(len(self.bwt), np.int64)
        step[order] = self.count + np.arange(len(order))
        again = self.lcp >= self.limit
        again[:-1] |= again[1:].copy()
        group = np.cumsum(self.lcp < self.limit)
        strings, starts, groups = [], [], []
        at, who = np.arange(self.count), np.arange(self.count)
        for k in range(int(self.length.max(initial=0))):
            keep = self.length[who] > k
            who = who[keep]
            at = step[at[keep]]
            if k + 1 >= self.limit:
                use = again[at]
                strings.append(who[use])
                starts.append(self.length[who[use]] - 1 - k)
                groups.append(group[at[use]])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(strings), join(starts), join(groups)


RANGES = "doc_id long, tie long, start int, stop int"


def ranges_of(doc_id: np.ndarray, tie: np.ndarray, start: np.ndarray, valid: np.ndarray) -> pa.RecordBatch:
    """Byte ranges that windows starting here cover."""
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64(), mask=~valid), pa.array(tie, pa.int64()), pa.array(start.astype(np.int32)), pa.array((start + WINDOW).astype(np.int32))], ["doc_id", "tie", "start", "stop"])


def sorted_ranges(distinct: DataFrame) -> DataFrame:
    """The ranges of windows of unequal segments of one anchor that occur earlier in another of them."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join([r["bytes"] for r in rows]), np.uint8)
        end = np.cumsum([len(r["bytes"]) for r in rows])
        first = np.append(0, end[:-1])
        there, low, high = shareable(flat, first, end, first + np.array([r["place"] for r in rows]))
        data = flat.tobytes()
        who, offset, group = Collection([data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]).classes()
        offset += (low - first[there])[who]
        who = there[who]
        doc = np.array([r["doc_id"] if r["doc_id"] is not None else np.iinfo(np.int64).min for r in rows], np.int64)
        valid = np.array([r["doc_id"] is not None for r in rows], bool)
        tie, start = np.array([r["tie"] for r in rows], np.int64), np.array([r["start"] for r in rows], np.int64)
        order = np.lexsort((start[who] + offset, tie[who], doc[who], valid[who], group))
        later = np.zeros(len(order), bool)
        later[1:] = group[order[1:]] == group[order[:-1]]
        who, at = who[order[later]], (start[who] + offset)[order[later]]
        return ranges_of(doc[who], tie[who], at, valid[who])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if size > SORTED_BYTES and r["anchor"] != rows[-1]["anchor"]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["bytes"])
        if rows:
            yield solve(rows)

    dealt = distinct.select("anchor", "doc_id", "tie", "start", "bytes", "place").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, RANGES)


def windowed_ranges(distinct: DataFrame) -> DataFrame:
    """The same for the largest groups: each window under a digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), r["doc_id"], r["tie"], r["start"] + k) for r in batch.to_pylist() for k in range(len(r["bytes"]) - WINDOW + 1) for d in [hashlib.blake2b(r["bytes"][k : k + WINDOW], digest_size=16).digest()]]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.int32(),), strict=True)], ["w1", "w2", "doc_id", "tie", "start"])

    each = distinct.select("doc_id", "tie", "start", "bytes").mapInArrow(run, "w1 long, w2 long, doc_id long, tie long, start int")
    at = F.struct("doc_id", "tie", "start")
    first = each.groupBy("w1", "w2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    return each.join(first, ["w1", "w2"]).where(at > F.col("first")).select("doc_id", "tie", "start", (F.col("start") + WINDOW).alias("stop"))


#: Unequal segments of one anchor that one task sorts.
HOT_GROUP = 4096


def removed_ranges(docs: DataFrame, scratch: Scratch, hot_group: int = HOT_GROUP) -> DataFrame:
    """doc_id, tie, start and stop of byte ranges that occur earlier; ranges may overlap."""
    at = F.struct("doc_id", "tie", "start")
    spans = scratch.table(run_places(docs), "runs")
    first_run = spans.groupBy("d1", "d2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    run_copies = scratch.table(spans.join(first_run, ["d1", "d2"]).where(at > F.col("first")).select("doc_id", "tie", "start", "stop"), "run_copies")
    scratch.drop("runs")
    # anchors that stand in unequal runs
    keys = anchor_keys(docs).groupBy("key").agg(F.min("run").alias("a"), F.max("run").alias("b")).where("a != b").select("key")
    shared = broadcast_bitmap(keys)
    all_places = scratch.table(places(docs, shared, False).drop("bytes", "place"), "places")
    # the anchor's hash and that of all bytes are 128 bits
    content = ["anchor", "d1"]
    firsts = scratch.table(all_places.groupBy(*content).agg(F.min(at).alias("first"), F.count("*").alias("n")), "firsts")
    copies = all_places.join(firsts.where("n > 1"), content).where(at > F.col("first"))
    whole = scratch.table(copies.select("doc_id", "tie", "start", (F.col("start") + F.col("windows") + (WINDOW - 1)).alias("stop")), "copies")
    unequal = scratch.table(firsts.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1"), "unequal")
    scratch.drop("places", "firsts")
    texts = places(docs, broadcast_bitmap(unequal.select("anchor")), True)
    # of equal segments the earliest stands for all; a hot segment is one row of each task before it moves
    distinct = texts.groupBy(*content).agg(F.min(F.struct("doc_id", "tie", "start", "bytes", "place")).alias("s")).select(*content, "s.*")
    distinct = scratch.table(distinct.join(unequal.select("anchor"), "anchor", "left_semi"), "distinct")
    whole = whole.unionByName(run_copies)
    hot = scratch.table(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot_group).select("anchor"), "hot")
    return whole.unionByName(sorted_ranges(distinct.join(hot, "anchor", "left_anti"))).unionByName(windowed_ranges(distinct.join(hot, "anchor", "left_semi")))


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: int, stop: int>>, kept binary"


def deduplicated(docs: DataFrame, hot_group: int = HOT_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (removed, maximal, ascending) and kept (bytes) of each document."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = removed_ranges(rows, scratch, hot_group)
    by_doc = ranges.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")).withColumnsRenamed({"doc_id": "_d", "tie": "_t"})
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tie") == F.col("_t")), "left").select("doc_id", "text", "ranges.start", "ranges.stop")
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            out = []
            for doc_id, text, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                n, gone, spans, kept = len(raw), 0, [], [raw]
                if start:
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, np.array(start), 1)
                    np.add.at(depth, np.array(stop), -1)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(depth)[:n] > 0, [False]]).astype(np.int8)))
                    pairs = edge.reshape(-1, 2).tolist()
                    spans = [{"start": a, "stop": b} for a, b in pairs]
                    gone = sum(b - a for a, b in pairs)
                    bounds = [0, *(x for p in pairs for x in p), n]
                    kept = [raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)]
                out.append((doc_id, n, gone, len(spans), spans, b"".join(kept)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(run, KEPT)
