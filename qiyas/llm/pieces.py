"""SentencePiece encoding and decoding, giant documents by a max-plus scan over chunks.

The model file holds a BPE vocabulary. A segmentation is what BPE makes of a text
exactly if it is so for every stretch between piece boundaries, so it is the one path of
weight 0 among paths whose other steps weigh minus infinity, and max-plus algebra finds it
without reading a text from its start: a document of more than ``CHUNK`` code points is
cut into chunks. The state at a cut is the piece that ends at it or lies across it. A
chunk's transfer matrix holds, for each state at its start and each at its end, 0 if
encoding the stretch from the one piece to the other yields both, else minus infinity.
Matrices of a document are combined associatively in a scan; the chosen states then let
each chunk be encoded on its own, in parallel. Results are the ids that the library
gives for the whole text.

No piece holds a word mark after another character, so words are encoded one by one, each
distinct word once for as long as a worker remembers it. A cut just before a word has
one state, and its matrices a single row or column.

Defined results: null text gives null ids and decodes to null; empty text has no ids;
U+2581 in a text is a space after decoding, as with the library; repeated rows give repeated
rows; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qiyas.llm import textbuf as tb
from qiyas.llm.scratch import Scratch

#: Code points of a chunk; longer documents are cut. SEARCH: places tried for a cut.
CHUNK, SEARCH = 16384, 64
CACHE_WORDS = 400_000
MARK = "▁"
NO = -np.inf


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encodes and decodes with one model; a form is a text with word marks for spaces and one before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.known = {p for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))}
        self.longest = max(map(len, self.known))
        special = lambda i: self.sp.is_control(i) or self.sp.is_unknown(i)
        self.bytes = [b"" if special(i) else bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.seen: dict[str, np.ndarray] = {}
        self.lead = self.sp.encode("\n")

    def stretch(self, form: str) -> list[int]:
        """ids of a stretch of a form."""
        if form.startswith(MARK):
            # the library puts a mark before a text
            return self.sp.encode(form[1:]) if len(form) > 1 else self._bare(form)
        return self._bare(form)

    def _bare(self, form: str) -> list[int]:
        ids = self.sp.encode("\n" + form)
        assert ids[: len(self.lead)] == self.lead
        return ids[len(self.lead) :]

    def packed(self, form: str) -> bytes:
        """ids of a stretch of a form that starts with a word mark, as little-endian 32-bit words, word by word."""
        if not form:
            return b""
        if form[0] != MARK or MARK + MARK in form:
            return np.array(self.stretch(form), "<u4").tobytes()
        words = form[1:].split(MARK)
        found = list(map(self.seen.get, words))
        if None in found:
            if len(self.seen) > CACHE_WORDS:
                self.seen.clear()
            missing = list({w for w, x in zip(words, found, strict=True) if x is None})
            new = {w: np.array(ids, "<u4").tobytes() if w else np.array(self._bare(MARK), "<u4").tobytes() for w, ids in zip(missing, self.sp.encode(missing, num_threads=1), strict=True)}
            found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
            self.seen.update((w, x) for w, x in new.items() if len(w) < 64)
        return b"".join(found)

    def form(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace")[1:]


def is_sync(form: str, at: int) -> bool:
    """A word starts here, so every segmentation has a boundary here."""
    return at in (0, len(form)) or form[at] == MARK and form[at - 1] != MARK


def states(codec: Codec, form: str, at: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces that may end at or lie across a place; one state, (at, at), where a word starts."""
    if is_sync(form, at):
        return [(at, at)]
    low, high = max(0, at - codec.longest), min(len(form), at + codec.longest)
    low = next((p for p in range(at - 1, low, -1) if is_sync(form, p)), low)
    high = next((p for p in range(at + 1, high) if is_sync(form, p)), high)
    return [(s, e) for s in range(low, at) for e in range(at, high + 1) if e - s == 1 or form[s:e] in codec.known]


def boundary(codec: Codec, form: str, near: int) -> int:
    """The place with the fewest states at or shortly after ``near``."""
    best, least = near, None
    for at in range(near, min(near + SEARCH, len(form))):
        n = len(states(codec, form, at))
        if least is None or n < least:
            best, least = at, n
        if n == 1:
            break
    return best


def transfer(codec: Codec, form: str, into: list[tuple[int, int]], out: list[tuple[int, int]]) -> np.ndarray:
    """The transfer matrix between the states at a chunk's start and at its end."""

    def spans(start: int, end: int) -> list[tuple[int, int]]:
        ends = np.cumsum([0, *codec_lengths(codec, form[start:end])]) + start
        return list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    begin, end = into[0][1] if len(into) == 1 and into[0][0] == into[0][1] else None, out[0][1] if len(out) == 1 and out[0][0] == out[0][1] else None
    low, high = max(e for _, e in into), min(s for s, _ in out)
    inner = [p for p in (next((p for p in range(low, high + 1) if is_sync(form, p)), None), next((p for p in range(high, low - 1, -1) if is_sync(form, p)), None)) if p is not None]
    m = np.full((len(into), len(out)), NO)
    if inner:  # a word starts inside: what comes before it and after it doesn't meet
        first, last = inner
        starts = [begin is not None or bool(x := spans(s, first)) and x[0] == (s, e) for s, e in into]
        closes = [end is not None or bool(x := spans(last, e)) and x[-1] == (s, e) for s, e in out]
        m[np.ix_(starts, closes)] = 0
        return m
    for i, (s, e) in enumerate(into):
        for stop in {e2 for _, e2 in out}:
            x = spans(s, stop)
            if not x or begin is None and x[0] != (s, e):
                continue
            for j, (s2, e2) in enumerate(out):
                if e2 == stop and (end is not None or x[-1] == (s2, e2) and (begin is not None or s2 >= e or (s2, e2) == (s, e))):
                    m[i, j] = 0
    return m


def codec_lengths(codec: Codec, form: str) -> list[int]:
    """Code points of each piece of a stretch; the bytes of an unknown code point count as one piece."""
    out, left = [], 0
    for i in codec.stretch(form):
        if codec.sp.is_byte(i):
            b = codec.bytes[i][0]
            if left:
                left -= 1
                continue
            left = 0 if b < 0x80 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            out.append(1)
        else:
            out.append(len(codec.sp.id_to_piece(i)))
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of all prefixes, by pairs: depth grows with the logarithm of their number."""
    if len(matrices) < 2:
        return list(matrices)
    pairs = scan([times(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(pairs[i // 2] if i % 2 else times(pairs[i // 2 - 1], matrices[i]))
    return out


def choose(matrices: list[np.ndarray]) -> list[int]:
    """The state at the end of each chunk on the best path; the document starts and ends in its only state."""
    prefix, out = scan(matrices), [0]
    for k in range(len(matrices) - 1, 0, -1):
        weight = prefix[k - 1][0] + matrices[k][:, out[-1]]
        best = int(weight.argmax())
        if weight[best] == NO:
            raise ValueError("no path of pieces through a document")
        out.append(best)
    return out[::-1]


ENCODED = "doc_id long, text_sha256 string, n_chunks int, ids binary"


def encoded(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_sha256, n_chunks and ids (packed little-endian 32-bit words) of each document."""
    model = path or public_model()
    numbered = docs.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    whole = F.col("text").isNull() | (F.length("text") < chunk)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in tb.slices(batches):
            ids = [None if (t := x.as_py()) is None else codec.packed(codec.form(t)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array([1] * batch.num_rows, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "text_sha256", "n_chunks", "ids"])

    small = numbered.where(whole).mapInArrow(direct, ENCODED)
    giants = numbered.where(~whole)
    if giants.isEmpty():
        return small
    scratch = Scratch(docs.sparkSession, "pieces")
    large = scratch.table(giants.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "text_sha256"), "giants")
    found = chosen(scratch.table(matrices(large, model, chunk), "matrices"))
    ids = chunk_ids(large.select("row", "text").join(found, "row"), model).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("all"))
    together = F.aggregate("all", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    done = large.select("row", "doc_id", "text_sha256").join(ids, "row").select("doc_id", "text_sha256", F.size("all").alias("n_chunks"), together.alias("ids"))
    return small.unionByName(done)


def matrices(large: DataFrame, model: str, chunk: int) -> DataFrame:
    """row, k, the ends of the states at both cuts, and the transfer matrix of each chunk."""
    cut = "row long, k int, form string, base int, start int, end int"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in tb.slices(batches):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                form = codec.form(text.as_py())
                places = [0, *(boundary(codec, form, p) for p in range(chunk, len(form) - SEARCH, chunk)), len(form)]
                margin = 2 * codec.longest
                rows = [(row, k, form[max(0, a - margin) : b + margin], max(0, a - margin), a, b) for k, (a, b) in enumerate(zip(places, places[1:]))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], [f.split()[0] for f in cut.split(", ")])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in tb.slices(batches, "form"):
            rows = []
            for r in batch.to_pylist():
                base = r["base"]
                into, out = states(codec, r["form"], r["start"] - base), states(codec, r["form"], r["end"] - base)
                rows.append((r["row"], r["k"], [e + base for _, e in into], [e + base for _, e in out], transfer(codec, r["form"], into, out).ravel().tolist()))
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row", "k", "into", "out", "matrix"])

    # chunks of a giant document are dealt to all tasks
    dealt = large.select("row", "text").mapInArrow(split, cut).repartition("row", "k")
    return dealt.mapInArrow(solve, "row long, k int, into array<int>, out array<int>, matrix array<double>")


def chosen(parts: DataFrame) -> DataFrame:
    """row and the places at which its chunks' own pieces begin and end. A task holds one document's matrices."""

    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        found = choose([np.array(r["matrix"]).reshape(len(r["into"]), len(r["out"])) for r in rows])
        places = [0, *(r["out"][j] for r, j in zip(rows, found, strict=True))]
        return pa.table({"row": pa.array([rows[0]["row"]], pa.int64()), "places": pa.array([places], pa.list_(pa.int32()))})

    return parts.groupBy("row").applyInArrow(run, "row long, places array<int>")


def chunk_ids(joined: DataFrame, model: str) -> DataFrame:
    """row, k and ids of each chunk between its places, each on its own."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in tb.slices(batches):
            for row, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                form = codec.form(text.as_py())
                n = len(places) - 1
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([form[a:b] for a, b in zip(places, places[1:])], pa.string())], ["row", "k", "form"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in tb.slices(batches, "form"):
            ids = [codec.packed(form.as_py()) for form in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["row", "k", "ids"])

    dealt = joined.select("row", "text", "places").mapInArrow(split, "row long, k int, form string").repartition("row", "k")
    return dealt.mapInArrow(run, "row long, k int, ids binary")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Replaces ids by decoded, the text that they stand for; other columns stay."""
    model = path or public_model()
    kept = [c for c in rows.columns if c != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in tb.slices(batches, "ids"):
            at = batch.schema.get_field_index("ids")
            texts = [None if not x.is_valid else codec.decode(np.frombuffer(x.as_py(), "<u4")) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], [*kept, "decoded"])

    return rows.mapInArrow(run, schema)
