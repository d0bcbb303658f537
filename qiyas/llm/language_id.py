"""Language identification by compression.

A language is a zstandard raw-content dictionary made of its texts. A text is cut
into blocks; each block is compressed with every language's dictionary, and the
language whose blocks come out smallest in all is chosen. When the next language is
nearly as small, ``rejected`` is true. Letters count in lower case; ASCII signs and
digits are left out on both sides. Blocks of all lengths take one setting, behind a run
of zeros that keeps the coder from storing short ones as they are.

Learning reads a bounded sample, as many distinct texts of each language, in the order of a hash,
as fill its dictionary of ``DICT_BYTES``; the last one is cut where that is full. Scoring covers whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
not rejected; texts of a null language aren't learned from, those of a null doc_id are; if no language was learned, every text is ``und``; equal sizes are
decided for the language with more documents, then by its name; repeated rows are scored alike; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a language's dictionary, and texts that are looked at for it if fewer would fill it.
DICT_BYTES, LEAST_DOCS = 48 << 10, 40
BLOCK_BYTES, LEVEL, LEAST_MATCH, CARRIER = 2048, 6, 3, bytes(64)
DROPPED = bytes(i for i in range(128) if not chr(i).isalpha() and i not in b" \n")
LINES_AS_SPACES = bytes.maketrans(b"\n", b" ")
#: Share of the smallest size by which the next language must be larger.
MARGIN = 0.01
SCORED = "doc_id long, lang_pred string, score double, rejected boolean"


def learn(rows: DataFrame) -> dict[str, bytes]:
    """The dictionary of each language, the most frequent first, from rows with text and lang (nulls are left out)."""
    known = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    size = F.least(F.length("text"), F.lit(DICT_BYTES)).alias("_size")
    hashed = known.select("lang", F.xxhash64("text").alias("_h"), size).groupBy("lang", "_h").agg(F.count("*").alias("_n"), F.min("_size").alias("_size"))
    # one row a language: its rows, its distinct texts and what they can give
    languages = hashed.groupBy("lang").agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"), F.sum("_size").alias("_b"))
    keyed = known.select("lang", F.xxhash64("text").alias("_h"), F.substring("text", 1, DICT_BYTES).alias("part")).join(F.broadcast(languages), "lang")
    # some four times the bytes wanted pass this cut, and copies count once, so no task ranks all of a language
    share = F.greatest(4 * F.lit(DICT_BYTES) / F.col("_b"), F.lit(LEAST_DOCS) / F.col("_d"))
    near = keyed.where(F.col("_h") / 2.0**64 + 0.5 < share).groupBy("lang", "_n", "_h").agg(F.min("part").alias("part"))
    upto = F.sum(F.length("part")).over(Window.partitionBy("lang").orderBy("_h"))
    # signs and digits fall away, so twice the bytes are taken
    chosen = near.withColumn("_before", upto - F.length("part")).where(F.col("_before") < 2 * DICT_BYTES).select("lang", "_n", "_h", "part").collect()
    out: dict[str, bytes] = {}
    for r in sorted(chosen, key=lambda r: (-r["_n"], r["lang"], r["_h"])):
        got = out.get(r["lang"], b"")
        if len(got) < DICT_BYTES:
            out[r["lang"]] = got + letters(r["part"])[: DICT_BYTES - len(got)] + b" "
    return out


def letters(text: str) -> bytes:
    return text.lower().encode().translate(LINES_AS_SPACES, DROPPED)


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=LEAST_MATCH)
        self.languages, self.coders = list(dictionaries), []
        for raw in dictionaries.values():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.coders.append(z.ZstdCompressor(compression_params=params, dict_data=d))
        self.letter = regex.compile(r"\p{L}")

    def sizes(self, text: str) -> np.ndarray:
        raw = letters(text)
        blocks = [CARRIER + raw[i : i + BLOCK_BYTES] for i in range(0, max(len(raw), 1), BLOCK_BYTES)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.coders])

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or text is None or not self.letter.search(text):
            return "und", 0.0, False
        sizes = self.sizes(text)
        best = int(sizes.argmin())  # the first of equals
        odds = np.exp((sizes[best] - sizes) * (64 / sizes[best]))
        rest = np.delete(sizes, best)
        return self.languages[best], float(1 / odds.sum()), bool(len(rest) and rest.min() < sizes[best] * (1 + MARGIN))


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), rejected for each row with doc_id and text."""
    kept = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICT_BYTES a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(kept.value)
        for batch in batches:
            found = [classify(x.as_py()) for x in batch.column(1)]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def held_out(modulus: int, remainder: int):
    """True for rows kept from learning: crc32 of doc_id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
