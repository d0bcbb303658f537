"""Runs of repeated words, found by matching blocks of power-of-two length.

A run is a stretch of words with smallest period q (words q apart are equal) and at least
max(LEAST_WORDS, LEAST_TIMES * q) words that no neighbouring word extends. For each scale
L = 1, 2, 4, ... the document is cut into aligned blocks of L words. A run whose period is in
[L, 2L) holds such a block among its first words, and the block comes again one period later.
So the blocks are keys of an Aho-Corasick automaton over word numbers, the automaton searches
the document, and an occurrence whose distance from its block is in [L, 2L) seeds an extension
to both sides, word by word, which gives the exact run.

What keeps the work near n log n, without losing a run:

- a block is a key only if each of its words comes again within 2L words, as in a run it does;
- only words in reach of such blocks are searched;
- a block whose whole reach lies in a run found at a smaller scale is no key: all its occurrences
  there belong to that run.

Each document is a row of its own and nothing is shuffled; memory grows with a slice of texts, or
with one document if that is longer.

Defined results: null and empty texts have no words and no runs; equal rows give equal rows; extra
columns are not read. ``planted`` leaves texts without a doc_id as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from qiyas.llm import textbuf as tb

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Rewrites the numbers of a document's words: (doc_id, number of words) to the place that each word is taken from.
Rewrite = Callable[[int | None, int], np.ndarray | None]
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def reach(w: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How far on each word comes again in its document (of: the row of each word); a large number if it doesn't."""
    out = np.full(len(w), np.iinfo(np.int64).max, np.int64)
    order = np.argsort(of * (int(w.max(initial=0)) + 1) + w, kind="stable")
    a, b = order[:-1], order[1:]
    same = (w[a] == w[b]) & (of[a] == of[b])
    out[a[same]] = b[same] - a[same]
    return out


def _agree(w: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j on (step 1), or before them (step -1), are equal."""
    n, size = 0, 32
    while True:
        if step > 0:
            most = min(size, len(w) - j - n)
            x, y = w[i + n : i + n + most], w[j + n : j + n + most]
        else:
            most = min(size, i - n)
            x, y = w[i - n - most : i - n][::-1], w[j - n - most : j - n][::-1]
        if most <= 0:
            return n
        differ = np.flatnonzero(x != y)
        if len(differ):
            return n + int(differ[0])
        n, size = n + most, size * 2


def _segments(blocks: np.ndarray, scale: int, n: int) -> Iterator[tuple[int, int]]:
    """The stretches in which occurrences of the blocks may lie, joined where they overlap."""
    begin, end = blocks + scale, np.minimum(blocks + 3 * scale - 1, n)
    cut = np.flatnonzero(begin[1:] > end[:-1]) + 1
    for part in np.split(np.arange(len(blocks)), cut):
        yield int(begin[part[0]]), int(end[part[-1]])


def document_runs(w: np.ndarray, again: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a document's word numbers w, by start, then period; again: see ``reach``."""
    n = len(w)
    found: dict[tuple[int, int], int] = {}
    covered: np.ndarray | None = None  # where the longest run found so far that holds a word ends
    scale = 1
    while LEAST_TIMES * scale <= n:
        far = np.concatenate([[0], np.cumsum(again >= 2 * scale)])
        blocks = np.arange(0, n - scale + 1, scale)
        blocks = blocks[far[blocks + scale] == far[blocks]]
        if covered is not None:
            blocks = blocks[covered[blocks] < blocks + 3 * scale - 1]
        fresh: list[tuple[int, int, int]] = []
        if len(blocks):
            keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            known: dict[tuple[int, ...], int] = {}
            content = {}
            for b in blocks.tolist():
                key = tuple(w[b : b + scale].tolist())
                content[b] = known.setdefault(key, len(known))
                if content[b] == len(known) - 1:
                    keys.add_word(key, content[b])
            keys.make_automaton()
            done: dict[int, tuple[int, int]] = {}  # of each distance the last stretch whose words agree with those after it
            for begin, end in _segments(blocks, scale, n):
                for last, c in keys.iter(tuple(w[begin:end].tolist())):
                    at = begin + last - scale + 1
                    b = at // scale * scale - scale  # the only aligned block at a distance in [scale, 2 * scale)
                    if content.get(b) != c:
                        continue
                    d = at - b
                    a, z = done.get(d, (0, 0))
                    if a <= b < z:
                        continue
                    a, z = b - _agree(w, b, at, -1), b + scale + _agree(w, b + scale, at + scale, 1)
                    done[d] = (a, z)
                    if z - a + d >= max(LEAST_WORDS, LEAST_TIMES * d) and (a, z + d) not in found:
                        fresh.append((a, z + d, d))
        if fresh and covered is None:
            covered = np.zeros(n, np.int64)
        for a, z, d in fresh:
            found.setdefault((a, z), d)
            np.maximum(covered[a:z], z, out=covered[a:z])
        scale *= 2
    return sorted((a, z - a, d) for (a, z), d in found.items())


def _codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw[at].tobytes())])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words, joined by one space."""
    if not len(starts):
        return b""
    lengths = ends - starts + 1
    offsets = np.cumsum(lengths) - lengths
    at = np.repeat(starts - offsets, lengths) + np.arange(int(lengths.sum()))
    out = raw[np.minimum(at, len(raw) - 1)]
    out[offsets + lengths - 1] = 32
    return out[:-1].tobytes()


def _found(batch: pa.RecordBatch, rewrite: Rewrite | None) -> pa.RecordBatch:
    raw, at = tb.utf8(batch.column(1))
    starts, ends, of = tb.ascii_words(raw, at)
    ids = batch.column(0).cast(pa.int64()).to_pylist()
    first = np.searchsorted(of, np.arange(len(ids) + 1))
    if rewrite is not None:
        source = np.arange(len(starts))
        for k, doc_id in enumerate(ids):
            moved = rewrite(doc_id, int(first[k + 1] - first[k]))
            if moved is not None:
                source[first[k] : first[k + 1]] = first[k] + moved
        starts, ends = starts[source], ends[source]
    codes = _codes(raw, starts, ends)
    again = reach(codes, of)
    runs, collapsed = [], []
    for k in range(len(ids)):
        a, z = int(first[k]), int(first[k + 1])
        here = document_runs(codes[a:z], again[a:z])
        keep = np.ones(z - a, bool)
        for s, n, q in here:
            keep[s + q : s + n] = False
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in here])
        collapsed.append(_joined(raw, starts[a:z][keep], ends[a:z][keep]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary())],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def detected(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, the runs of each text by start and period, and the text without what its runs repeat.

    A word goes if a run holds it behind the run's first period. ``rewrite`` replaces words by earlier ones before the search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            yield _found(batch, rewrite)

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The rewriting of the contract: in a tenth of the documents the words from some place on repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def digest(runs: list[tuple[int, int, int]]) -> str:
    """What runs_sha256 is of a list of (start, length, period)."""
    return hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
