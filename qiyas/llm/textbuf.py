"""Texts of an Arrow batch as flat byte arrays, cut into slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20


def release() -> None:
    """Gives memory that this worker has freed back to the system, where the C library can: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most ``limit`` bytes, or one row; no row is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        _, at = utf8(col)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
    release()


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each byte, the number of its row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_in_place(x: np.ndarray, spare: np.ndarray) -> None:
    """mix, written over x; spare is an array of its length."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, np.uint64(shift), out=spare)
        x ^= spare
        if factor is not None:
            x *= np.uint64(factor)


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9FB21C651E98DF25


#: Powers that a worker keeps for each base: enough for a slice.
KEPT_POWERS = 4 << 20
_kept: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** k for k < n, modulo 2**64; not to be written to."""
    found = _kept.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1), base, np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        if n <= KEPT_POWERS:
            _kept[base] = found
    return found[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of code(b_j) * BASE**j over j < i; code is a random 64-bit word for each byte."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODES[raw] * powers(len(raw)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand; inverse: powers(n + 1, INVERSE)."""
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def ascii_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: runs of bytes other than 0x20 and 0x09 to 0x0D that end with their row."""
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    begins[inner] = solid[inner]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    closes[inner[1:] - 1] = solid[inner[1:] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
