"""Best-fit packing of token sequences by length patterns.

``packed`` tokenises every whole text, cuts only documents of more than
``capacity`` ids, and packs the pieces into sequences of ``capacity`` ids.

Method: the lengths' histogram (at most ``capacity`` bins, whatever the corpus)
goes to the driver. Patterns of up to ``depth`` lengths that fill a sequence are
enumerated, non-negative least squares fits how often each repeats so that the
patterns' lengths add up to the histogram, the counts are rounded down, and the
residual lengths are packed by best fit, largest first, again on counts alone. The
plan is a table of runs: run r takes the pieces of length l that have the numbers
[from, to) within l, and gives each a sequence and an offset by arithmetic.

Defined results: null text is empty and is one piece of the end id alone; equal
or repeated rows are separate pieces; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qiyas.llm.scratch import Scratch

CAPACITY = 1024
END_ID = 2
DEPTH = 3
#: Pieces of one length that one task numbers, about.
SHARD_ROWS = 1 << 20
#: Fits, each to what rounding has left of the one before.
REFITS = 5
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The cut pieces of every document; encoder makes, on the executor, a function from a text to packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                out += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def patterns(lengths: np.ndarray, capacity: int, depth: int) -> np.ndarray:
    """Multisets of up to ``depth`` of these lengths, descending, zero-padded, that leave less than the shortest free or fill exactly."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    below = np.maximum.accumulate(np.where(there, np.arange(capacity + 1), 0))  # the largest length that fits
    out = [(a, 0, 0) for a in lengths if below[capacity - a] == 0]
    for a in lengths[::-1]:
        room = capacity - a
        b = lengths[(lengths <= min(room, a))]
        if not len(b):
            continue
        c = np.where(below[room - b] <= b, below[room - b], 0)
        if depth < 3:
            c = np.zeros_like(c)
        exact = (a + b + c == capacity) | (c == 0) & (below[room - b] == 0)
        out += [(int(a), int(x), int(y)) for x, y in zip(b[exact], c[exact], strict=True)]
    return np.array(out, np.int64).reshape(-1, 3)


def fit(found: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative least squares: repeat counts x with A x near the histogram, by accelerated projected gradient on the sparse columns."""
    n = len(found)
    if not n:
        return np.zeros(0)
    rows, cols = found.ravel(), np.repeat(np.arange(n), found.shape[1])
    keep = rows > 0
    rows, cols = rows[keep], cols[keep]
    goal = histogram.astype(float)
    weight = 1 / np.sqrt(np.maximum(goal, 1))  # relative errors of all bins count
    forward = lambda x: np.bincount(rows, x[cols], len(goal))
    scale = np.bincount(cols, (weight[rows] ** 2) * np.bincount(rows, minlength=len(goal))[rows], n)  # a bound of the curvature in each coordinate
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        grad = np.bincount(cols, (weight**2 * (forward(y) - goal))[rows], n)
        new = np.maximum(0, y - grad / (scale * found.shape[1]))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats): best fit, largest first, on counts: each longest piece takes the largest pieces that still fit."""
    out, left = [], left.copy()
    while left.any():
        a = int(np.flatnonzero(left)[-1])
        chosen, room, used = [a], capacity - a, {a: 1}
        while room > 0:
            free = left[: room + 1].copy()
            for v, n in used.items():
                if v <= room:
                    free[v] -= n
            fits = np.flatnonzero(free > 0)
            if not len(fits):
                break
            b = int(fits[-1])
            take = min(room // b, int(left[b]) - used.get(b, 0))
            chosen += [b] * take
            used[b] = used.get(b, 0) + take
            room -= b * take
        repeats = min(int(left[k]) // v for k, v in used.items())
        for k, v in used.items():
            left[k] -= v * repeats
        out.append((tuple(chosen), repeats))
    return out


def plan(histogram: np.ndarray, capacity: int = CAPACITY, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences; histogram[l]: pieces of length l, 0 < l <= capacity."""
    left = histogram.astype(np.int64).copy()
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    for _ in range(REFITS):
        found = patterns(np.flatnonzero(left), capacity, depth)
        count = np.floor(fit(found, left) + 1e-6).astype(np.int64) if len(found) else np.zeros(0, np.int64)
        took = 0
        for k in np.argsort(-count, kind="stable"):
            if count[k] <= 0:
                break
            lengths = tuple(int(v) for v in found[k] if v)
            most = min(int(left[v]) // lengths.count(v) for v in lengths)
            if (n := min(int(count[k]), most)) > 0:
                for v in lengths:
                    left[v] -= n
                out.append((lengths, n))
                took += n
        if not took:
            break
    return out + best_fit(left, capacity)


def runs(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, first sequence, pieces of this length in a sequence, first offset): disjoint runs that cover each length's numbers."""
    out, taken, sequence = [], {}, 0
    for lengths, repeats in planned:
        offset = 0
        for v in dict.fromkeys(lengths):
            k = lengths.count(v)
            a = taken.get(v, 0)
            out.append((v, a, a + k * repeats, sequence, k, offset))
            taken[v], offset = a + k * repeats, offset + k * v
        sequence += repeats
    return out


def placed(cut_pieces: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``, which must be a written table.

    A full piece is a sequence of its own and needs no number. Each other piece gets a number within its length from its
    shard; shards follow the largest count of a length, so no length is numbered by one task.
    """
    spark = cut_pieces.sparkSession
    full = cut_pieces.where(F.col("length") == capacity)
    rest = cut_pieces.where(F.col("length") < capacity)
    sizes = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # a row a length
    shards = max(1, -(-max(sizes.values(), default=0) // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(shards)).cast("int")
    dealt = rest.withColumn("_shard", shard)
    counts = dealt.groupBy("length", "_shard").agg(F.count("*").alias("_n")).collect()  # about a row for each SHARD_ROWS pieces, or a length
    histogram, before = np.zeros(capacity + 1, np.int64), []
    for r in sorted(counts, key=lambda r: (r["length"], r["_shard"])):
        before.append((r["length"], r["_shard"], int(histogram[r["length"]])))
        histogram[r["length"]] += r["_n"]
    planned = plan(histogram, capacity, depth)
    table = runs(planned)
    starts = spark.createDataFrame(before, "length long, _shard int, _before long")
    found = spark.createDataFrame(table, "length long, _from long, _to long, _sequence long, _k long, _offset long")
    row = F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "piece"))
    number = dealt.withColumn("_row", row).join(F.broadcast(starts), ["length", "_shard"]).withColumn("_number", F.col("_before") + F.col("_row") - 1)
    of_length = found.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_sequence", "_k", "_offset"))).alias("_runs"))
    # the runs of a length are few thousands at most: their number is bounded by the plan's, not by the corpus
    at = number.join(F.broadcast(of_length), "length").withColumn("_run", F.element_at(F.filter("_runs", lambda r: (r["_from"] <= F.col("_number")) & (F.col("_number") < r["_to"])), 1))
    inner = F.col("_number") - F.col("_run._from")
    packed_rest = at.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_run._sequence") + F.floor(inner / F.col("_run._k"))).cast("long").alias("sequence_id"),
        (F.col("_run._offset") + (inner % F.col("_run._k")) * F.col("length")).cast("long").alias("offset"),
    )
    alone = (F.monotonically_increasing_id() + sum(n for _, n in planned)).alias("sequence_id")
    return packed_rest.unionByName(full.select("doc_id", "piece", "start", "length", "ids_crc32", alone, F.lit(0).cast("long").alias("offset")))


def byte_bpe() -> Callable[[str], bytes]:
    """The encoder of the public 50k byte-level vocabulary, made on the executor; special tokens as its file has them."""
    import json

    import public_tokenizers

    from qiyas.llm.byte_bpe import Encoder

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        specials = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, specials)


def packed(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]] = byte_bpe, capacity: int = CAPACITY, end_id: int = END_ID, depth: int = DEPTH) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    written = Scratch(docs.sparkSession, "packing").table(pieces(docs, encoder, capacity, end_id), "pieces")
    return placed(written, capacity, depth)
