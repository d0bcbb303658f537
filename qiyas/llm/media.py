"""Media columns: content-defined chunks, stored once, that reconstruct verified media.

``encode`` turns a text into a medium: its UTF-8 bytes, filled up with 255 to a
positive multiple of ``FRAME``, as the samples of an 8-bit grey image in the binary
portable-graymap form. A rolling gear hash cuts media into chunks where the content
says so; equal chunks have equal digests wherever they stand. A medium is kept as its
ordered chunk list. Chunks whose digest occurs once in the corpus stay in the list
itself; a digest that occurs more often is kept once, in the chunk table, and the list
refers to it. Reading joins the references with the chunk table, puts the chunks in
order, checks the digest of the whole medium, and only then computes features.

Which digests are shared is found exactly, by grouping digests; a bitmap of bounded
size tells writers which chunks may be shared. Where it errs, a chunk that occurs once
is kept in the chunk table instead of in its list, and results are the same.

Defined results: null text is empty and gives one frame of 255; equal texts have equal
values; repeated rows give repeated rows; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qiyas.llm import textbuf as tb
from qiyas.llm.scratch import Scratch

FRAME, SIDE = 576, 24
#: Chunk lengths: none below LEAST but a medium's last; 1 cut in AVERAGE bytes after that; none above MOST.
LEAST, AVERAGE, MOST = 1024, 4096, 32768
#: Bits of the bitmap of shared digests: 1 MB to each executor.
BITS = 23
GEAR = (tb.mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5EED)) >> np.uint64(32)).astype(np.uint32)


def encode(raw: bytes) -> bytes:
    """The stored form of a payload whose length is a positive multiple of FRAME."""
    return b"P5\n%d %d\n255\n" % (SIDE, len(raw) // SIDE) + raw


def decode(stored: bytes) -> bytes:
    """The payload of a stored form; ValueError if it isn't one."""
    kind, size, most, raw = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or width * height != len(raw):
        raise ValueError("not a graymap of 8-bit samples")
    return raw


def padded(raw: bytes) -> bytes:
    n = max(1, -(-len(raw) // FRAME)) * FRAME
    return raw + b"\xff" * (n - len(raw))


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling gear hash after each byte: sum of GEAR[b[i - j]] << j over the last 32 bytes, by doubling."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k].copy() << np.uint32(k)
    return h


def cuts(stored: bytes) -> list[int]:
    """The ends of the chunks of one medium."""
    n = len(stored)
    if n <= LEAST:
        return [n]
    marks = np.flatnonzero(gear(np.frombuffer(stored, np.uint8)) >> np.uint32(32 - AVERAGE.bit_length() + 1) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        k = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def slot(digests: bytes) -> int:
    return int.from_bytes(digests[:8], "little") >> (64 - BITS)


def chunk_digests(docs: DataFrame) -> DataFrame:
    """One row for each chunk of each text's medium: digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            out = []
            for text in batch.column(0):
                stored = encode(padded((text.as_py() or "").encode()))
                a = 0
                for b in cuts(stored):
                    out.append(digest(stored[a:b]))
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["digest"])

    return docs.select("text").mapInArrow(run, "digest binary")


def shared_bitmap(digests: DataFrame) -> bytes:
    """2**BITS bits, on for every digest that occurs more than once."""
    often = digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: set[int] = set()
        for batch in batches:
            slots.update(slot(x) for x in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(slots), pa.int64())], ["slot"])

    bits = np.zeros(1 << BITS, bool)
    # at most 2**BITS rows of 8 bytes
    found = often.mapInArrow(run, "slot long").distinct().toArrow().column(0).to_numpy()
    bits[found] = True
    return np.packbits(bits).tobytes()


STORED = "row long, doc_id long, n_bytes long, media_bytes long, media_sha256 string, parts array<struct<digest: binary, bytes: binary>>"


class Shared:
    """Membership in the bitmap, on an executor."""

    def __init__(self, bitmap: bytes):
        self.bits = np.frombuffer(bitmap, np.uint8)

    def __contains__(self, d: bytes) -> bool:
        s = slot(d)
        return bool(self.bits[s >> 3] >> (7 - (s & 7)) & 1)


def media_lists(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """Media as ordered chunk lists; a part holds its bytes (zstandard) unless its digest may be shared. row numbers the media."""
    kept = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        shared, pack = Shared(kept.value), zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 40
        for batch in tb.slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                stored, parts, a = encode(padded(raw)), [], 0
                for b in cuts(stored):
                    d = digest(stored[a:b])
                    parts.append({"digest": d, "bytes": None if d in shared else pack.compress(stored[a:b])})
                    a = b
                rows.append((number, doc_id, len(raw), len(stored), hashlib.sha256(stored).hexdigest(), parts))
                number += 1
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row", "doc_id", "n_bytes", "media_bytes", "media_sha256", "parts"])

    return docs.select("doc_id", "text").mapInArrow(run, STORED)


def chunk_table(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """digest and bytes (zstandard) of every chunk that may be shared, once."""
    kept = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared, pack = Shared(kept.value), zstandard.ZstdCompressor(level=3)
        for batch in tb.slices(batches):
            out: dict[bytes, bytes] = {}
            for text in batch.column(0):
                stored, a = encode(padded((text.as_py() or "").encode())), 0
                for b in cuts(stored):
                    d = digest(stored[a:b])
                    if d in shared and d not in out:
                        out[d] = pack.compress(stored[a:b])
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["digest", "bytes"])

    return docs.select("text").mapInArrow(run, "digest binary, bytes binary").groupBy("digest").agg(F.min("bytes").alias("bytes"))


def joined(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """Media with the bytes of every part, the shared ones from the chunk table."""
    refers = F.exists("parts", lambda p: p["bytes"].isNull())
    wanted = media.where(refers).select("row", F.posexplode("parts").alias("pos", "part")).where("part.bytes is null").select("row", "pos", "part.digest")
    found = wanted.join(chunks, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("found"))
    # the n-th part without bytes takes the n-th found: both are in the list's order
    nth = lambda i: F.size(F.filter(F.slice("parts", 1, i + 1), lambda p: p["bytes"].isNull()))
    filled = F.transform("parts", lambda p, i: F.when(p["bytes"].isNull(), F.element_at("found.bytes", nth(i))).otherwise(p["bytes"]))
    whole = media.where(refers).join(found, "row").withColumn("bytes", filled)
    return media.where(~refers).withColumn("bytes", F.col("parts.bytes")).unionByName(whole.drop("found")).drop("parts", "row")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(payload: bytes) -> str:
    """Mean sample in thousandths, then the samples in 16 equal ranges of value in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return ",".join(map(str, [int(x.sum(dtype=np.int64)) * 1000 // len(x), *shares.tolist()]))


def read(media: DataFrame) -> DataFrame:
    """Features of media with all their chunks' bytes at hand; a medium that isn't what was stored raises."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc_id, n, size, sha, chunks = (c[i].as_py() for c in batch.columns)
                stored = b"".join(map(unpack.decompress, chunks))
                found = hashlib.sha256(stored).hexdigest()
                if len(stored) != size or found != sha:
                    raise ValueError(f"the medium of document {doc_id} isn't what was stored")
                payload = decode(stored)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), size, found, features(payload)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in READ.split(", ")])

    return media.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "bytes").mapInArrow(run, READ)


def stored_and_read(docs: DataFrame) -> DataFrame:
    """Stores the media of all texts, then reads them back: one row of READ for each document."""
    scratch = Scratch(docs.sparkSession, "media")
    bitmap = shared_bitmap(chunk_digests(docs))
    media = scratch.table(media_lists(docs, bitmap), "media")
    chunks = scratch.table(chunk_table(docs, bitmap), "chunks")
    return read(joined(media, chunks))
