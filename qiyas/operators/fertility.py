"""How many pieces of a vocabulary the words of a language take, and what one vocabulary has that another lacks.

A vocabulary is a table of pieces with the ranks of their merges. Texts are cut into distinct pre-tokens with counts, and each
distinct one is merged once: in every round the neighbours whose joined piece has the lowest rank become one, until no neighbours
make a piece. Bytes are written as two hexadecimal digits throughout, so pieces needn't be text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qiyas.sources import shared

# fixed value: how a text is cut before its bytes are merged
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# end of fixed value


def ranks(lines: DataFrame) -> DataFrame:
    """piece (hexadecimal) and rank of lines ``base64 rank`` in value, as ``spark.read.text`` gives them."""
    part = F.split(F.trim(F.regexp_replace("value", r"\s+$", "")), " ")
    return lines.where(F.trim("value") != "").select(F.hex(F.unbase64(part[0])).alias("piece"), part[1].cast("long").alias("rank"))


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){PRE_TOKEN}"), F.lit(0))


def _joined(symbols: Column, piece: Column) -> Column:
    """Every two neighbours that make ``piece`` become it, from the left."""
    step = lambda done, s: F.when(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), s) == piece, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(piece))).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(symbols, F.array().cast("array<string>"), step)


def merged(words: DataFrame, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """word and pieces (how many it takes) of distinct words.

    One round a merge: the pairs of words that still change meet the ranks by a join, of which Spark broadcasts a vocabulary that is small enough.
    A word leaves as soon as no two neighbours make a piece, so later rounds hold the few long words only. Each round is written, which cuts its lineage.
    """
    # a single byte that the vocabulary has is a piece of its own, and one that it lacks counts as one too
    rows = words.select(word, F.regexp_extract_all(F.hex(F.encode(word, "utf-8")), F.lit(".."), F.lit(0)).alias("symbols"))
    pieces = shared.written(vocabulary.groupBy("piece").agg(F.min("rank").alias("rank")), "ranks")
    now, done = shared.written(rows, "merge-0"), []
    round_ = 0
    while True:
        pairs = now.select(word, F.explode(F.zip_with(F.slice("symbols", F.lit(1), F.greatest(F.size("symbols") - 1, F.lit(0))), F.slice("symbols", 2, 1 << 30), lambda a, b: F.concat(a, b))).alias("piece"))
        best = pairs.join(pieces, "piece").groupBy(word).agg(F.min(F.struct("rank", "piece")).alias("_b")).select(word, F.col("_b.piece").alias("_piece"))
        round_ += 1
        after = shared.written(now.join(best, word, "left").select(word, F.when(F.col("_piece").isNull(), F.col("symbols")).otherwise(_joined(F.col("symbols"), F.col("_piece"))).alias("symbols"), F.col("_piece").isNotNull().alias("_on")), f"merge-{round_}")
        done.append(after.where("not _on").select(word, F.size("symbols").alias("pieces")))
        now = after.where("_on").select(word, "symbols")
        if now.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def measured(texts: DataFrame, vocabulary: DataFrame, group: str, text: str = "text") -> DataFrame:
    """group, pieces, words and per_word: pieces of all texts of a group against their words between white space. Null texts don't count; without words per_word is 0."""
    counts = texts.where(F.col(text).isNotNull()).select(group, F.explode(pre_tokens(F.col(text))).alias("word")).groupBy(group, "word").agg(F.count("*").alias("n"))
    counts = shared.written(counts, "pre-tokens")
    sizes = merged(counts.select("word").distinct(), vocabulary)
    pieces = counts.join(sizes, "word").groupBy(group).agg(F.sum(F.col("n") * F.col("pieces")).alias("pieces"))
    words = texts.groupBy(group).agg(F.coalesce(F.sum(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")), F.lit(0)).alias("words"))
    out = words.join(pieces, group, "left").na.fill(0, ["pieces"])
    return out.select(group, "pieces", "words", F.when(F.col("words") > 0, F.col("pieces") / F.col("words")).otherwise(0.0).alias("per_word"))


def compared(fertility: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """One row: how many more pieces a word of the first group takes than one of the second."""
    of = lambda g: F.max(F.when(F.col(group) == g, F.col("per_word")))
    return fertility.agg(of(first).alias("first"), of(second).alias("second")).withColumn("ratio", F.col("first") / F.nullif(F.col("second"), F.lit(0.0)))


def is_control(piece: Column) -> Column:
    """Whether a piece is a mark of control: longer than two characters and within <> or []."""
    within = (piece.startswith("<") & piece.endswith(">")) | (piece.startswith("[") & piece.endswith("]"))
    return (F.length(piece) > 2) & within


def added(vocabularies: DataFrame, pairs: DataFrame) -> DataFrame:
    """label, words, special and controlled: the pieces that a tuned vocabulary has beyond its base, and whether it has no further words.

    vocabularies(name, piece), pairs(label, base, tuned). Pairs of which a vocabulary is missing have null counts: they weren't measured.
    """
    pieces = vocabularies.select("name", "piece").distinct()
    known = pieces.select("name").distinct()
    ours = pairs.select("label", "base", F.col("tuned").alias("name")).join(pieces, "name").select("label", "base", "piece")
    extra = ours.join(pieces.withColumnRenamed("name", "base"), ["base", "piece"], "left_anti")
    special = is_control(F.col("piece"))
    counted = extra.groupBy("label").agg(F.count_if(~special).alias("words"), F.count_if(special).alias("special"))
    there = pairs.join(known.select(F.col("name").alias("base")), "base", "left_semi").join(known.select(F.col("name").alias("tuned")), "tuned", "left_semi").select("label", F.lit(True).alias("_there"))
    out = pairs.select("label").join(there, "label", "left").join(counted, "label", "left")
    count = lambda c: F.when(F.col("_there"), F.coalesce(c, F.lit(0))).alias(c)
    return out.select("label", count("words"), count("special")).withColumn("controlled", F.col("words") == 0)
