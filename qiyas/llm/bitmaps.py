"""Bitmaps of hashed keys: of fixed size whatever the corpus, so safe to broadcast.

They only spare work: a key that is wrongly found in one is told apart later by an
exact grouping or join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: 4 MB.
BITS = 25


def slots(keys: np.ndarray) -> np.ndarray:
    """The bit of each 64-bit key: its top bits."""
    return keys.astype(np.int64).view(np.uint64) >> np.uint64(64 - BITS)


def broadcast_bitmap(keys: DataFrame) -> Broadcast:
    """A bitmap of a table with one column of hashed longs.

    Each task packs its own bits in blocks of 4 kB; the blocks are merged, so 2**BITS / 8 bytes reach the driver.
    """
    block = 1 << 15

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            if bits is None:
                bits = np.zeros(1 << BITS, bool)
            bits[slots(batch.column(0).to_numpy(zero_copy_only=False))] = True
        if bits is not None:
            grid = bits.reshape(-1, block)
            there = np.flatnonzero(grid.any(axis=1))
            packed = [np.packbits(grid[i]).tobytes() for i in there]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(packed, pa.binary())], ["block", "bits"])

    def merge(key, table):
        out = np.zeros(block // 8, np.uint8)
        for x in table.column("bits"):
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    merged = keys.mapInArrow(pack, "block int, bits binary").groupBy("block").applyInArrow(merge, "block int, bits binary")
    out = np.zeros(1 << BITS, bool)
    for r in merged.collect():
        out[r["block"] * block : (r["block"] + 1) * block] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8)).astype(bool)
    return keys.sparkSession.sparkContext.broadcast(np.packbits(out).tobytes())


class Member:
    """Which keys may be in a bitmap, on an executor."""

    def __init__(self, bitmap: Broadcast):
        self.bits = np.frombuffer(bitmap.value, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        s = slots(keys)
        return (self.bits[s >> np.uint64(3)] >> (np.uint8(7) - (s & np.uint64(7)).astype(np.uint8))) & 1 == 1
