"""Votes dealt anew many times in the arrays of a task: the md5 of many short texts at once, and the shuffles of a block."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Votes in a packed row, and texts that are hashed at once (their words stay in a core's cache).
PACKED, AT_ONCE = 1 << 16, 1 << 14
NONE = np.iinfo(np.int32).max
# fixed values: md5
SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
# end of fixed values


def md5_numbers(prefix: bytes, ends: np.ndarray) -> np.ndarray:
    """The first eight hex digits of the md5 of prefix and end as numbers. ends(length, n): bytes of n ends of equal length.

    Texts of up to 55 bytes are one block of md5, which is worked out for all of them together; longer ones go one by one.
    """
    length, n = len(prefix) + len(ends), ends.shape[1]
    if length > 55:
        return np.array([int.from_bytes(hashlib.md5(prefix + e.tobytes()).digest()[:4], "big") for e in ends.T], np.uint32)
    block = (prefix + bytes(len(ends)) + b"\x80").ljust(56, b"\0") + (8 * length).to_bytes(8, "little")
    fixed = [int(w) for w in np.frombuffer(block, "<u4")]
    varying: dict[int, np.ndarray] = {}
    for at, column in enumerate(ends, len(prefix)):
        word = varying.setdefault(at // 4, np.zeros(n, np.uint32))
        word |= column.astype(np.uint32) << np.uint32(8 * (at % 4))
    a, b, c, d = (np.full(n, s, np.uint32) for s in START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the first word of the digest is made by the 61st step
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32((SINES[i] + fixed[WORDS[i]]) & 0xFFFFFFFF)
        if WORDS[i] in varying:
            f += varying[WORDS[i]]
        np.left_shift(f, np.uint32(TURNS[i]), out=t)
        f >>= np.uint32(32 - TURNS[i])
        f |= t
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    b += np.uint32(START[0])
    return b.byteswap()


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as rows of one column, votes: up to some PACKED of them in bytes."""

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        table = pa.table({c: x.dictionary_encode() if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) else x for c, x in zip(table.column_names, table.columns, strict=True)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["votes"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACKED:
            yield row(held)
            held = []
    if sum(b.num_rows for b in held):
        yield row(held)


def unpacked(rows: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows]).unify_dictionaries().combine_chunks()


class Deck:
    """A model's votes by item, nulls last: the place of each in the items of all models, its letter, and the digits of its item."""

    def __init__(self, model: str, items: np.ndarray, null: np.ndarray, slots: np.ndarray, letters: np.ndarray):
        order = np.lexsort((items, null))
        self.model, self.slots, self.letters = model, slots[order], letters[order]
        self.highest = np.where(self.letters == NONE, -1, self.letters).astype(np.int32)
        known = len(items) - int(null.sum())
        texts = items[order][:known].astype("S")
        digits = texts.view(np.uint8).reshape(known, texts.itemsize)
        lengths = (digits != 0).sum(axis=1)
        self.ends = [(at := np.flatnonzero(lengths == k), np.ascontiguousarray(digits[at, :k].T)) for k in np.unique(lengths)]
        self.nulls = range(known, len(items))

    def dealt(self, seed: int, r: int) -> np.ndarray:
        """Which vote each place gets: votes in the order of their hashes."""
        hashes, prefix = np.empty(len(self.slots), np.uint64), f"{seed}|{r}|{self.model}".encode()
        for at, ends in self.ends:
            for x in range(0, len(at), AT_ONCE):
                hashes[at[x : x + AT_ONCE]] = md5_numbers(prefix + b"|", ends[:, x : x + AT_ONCE])
        if self.nulls:
            hashes[self.nulls.start :] = int.from_bytes(hashlib.md5(prefix).digest()[:4], "big")
        hashes <<= np.uint64(32)
        hashes |= np.arange(len(hashes), dtype=np.uint64)
        hashes.sort()
        return (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)


def unanimous_wrong(votes: pa.Table, seed: int, rounds: Iterable[int]) -> list[int]:
    """For each shuffle, the items of two votes or more that all have one letter, which isn't the key. votes(model, item_id, letter, key)."""

    def codes(c: str, number: dict[str, int]) -> np.ndarray:
        x = votes[c].combine_chunks()
        of = np.array([number[v] for v in x.dictionary.to_pylist()] + [NONE], np.int32)
        return of[x.indices.fill_null(len(of) - 1).to_numpy(zero_copy_only=False)]

    each = {c: votes[c].combine_chunks().dictionary.to_pylist() for c in ("model", "letter", "key")}
    number = {v: i for i, v in enumerate(sorted({*each["letter"], *each["key"]}))}
    model, letter, key = codes("model", {m: i for i, m in enumerate(each["model"])}), codes("letter", number), codes("key", number)
    null = votes["item_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    item = votes["item_id"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    known, slot = np.unique(item, return_inverse=True)
    slot = np.where(null, len(known), slot)
    size = len(known) + 1
    keys = np.full(size, NONE, np.int32)
    np.minimum.at(keys, slot, key)
    asked = (np.bincount(slot, minlength=size) >= 2) & (keys != NONE)
    decks = [Deck(m, item[at], null[at], slot[at], letter[at]) for i, m in enumerate(each["model"]) if len(at := np.flatnonzero(model == i))]
    found = []
    for r in rounds:
        low, high = np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        for deck in decks:
            order = deck.dealt(seed, r)
            np.minimum.at(low, deck.slots, deck.letters[order])
            np.maximum.at(high, deck.slots, deck.highest[order])
        found.append(int((asked & (low == high) & (low != keys)).sum()))
    return found
