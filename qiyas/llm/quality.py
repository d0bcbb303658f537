"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed features (words, the punctuation that hangs on
words, shapes of words, words that repeat the one before, line breaks), weighted by
log and inverse document frequency and projected on the leading singular vectors of
a labelled sample. The sample's vectors are broadcast; each document's cosine with
every one of them is computed exactly, in blocks, and the labels vote, each weighted
by its similarity.

Learning reads a bounded sample: ``SAMPLE_DOCS`` labelled documents of each label,
taken by a hash of their id. Scoring covers whole texts.

Defined results: null and empty texts have no features and get the sample's share of
label 1 as their score, as have all texts when nothing was learned (then 0.5); equal
texts get equal scores; extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qiyas.llm import textbuf as tb

#: Labelled rows of each label that are learned from, hashed features, latent dimensions.
SAMPLE_DOCS, FEATURES, LATENT = 1500, 4096, 48
#: Directions weaker than this share of the strongest are noise.
NOISE = 1e-4
#: Similarities count by this power, so near neighbours decide.
SHARPNESS = 24.0
BLOCK = 256
THRESHOLD = 0.3
SCORED = "doc_id long, score double"
SHAPES = 512  # features [0, SHAPES) are of form, the others are words


def count_features(column: pa.Array) -> np.ndarray:
    """Counts (rows x FEATURES) of the features of whole texts."""
    raw, at = tb.utf8(column)
    n = len(at) - 1
    out = np.zeros((n, FEATURES), np.float32)
    if not len(raw):
        return out
    starts, ends, rows = tb.ascii_words(raw, at)
    low = tb.lower(raw)
    sums, inverse = tb.prefix_sums(low), tb.powers(len(low) + 1, tb.INVERSE)
    words = tb.span_hashes(sums, starts, ends, inverse)

    def add(row: np.ndarray, feature: np.ndarray) -> None:
        out.ravel()[:] += np.bincount(row * FEATURES + feature, minlength=n * FEATURES).astype(np.float32)

    add(rows, (words % np.uint64(FEATURES - SHAPES)).astype(np.int64) + SHAPES)
    if len(words):
        # form: bytes that are neither letters, digits, white space nor part of a longer code point, two by two
        punct = (raw < 128) & ~((low >= 97) & (low <= 122)) & ~((raw >= 48) & (raw <= 57)) & (raw > 32)
        of = tb.row_of(at)
        where = np.flatnonzero(punct)
        after = np.minimum(where + 1, len(raw) - 1)
        inside = where + 1 < at[1:][of[where]]  # the byte behind a text's last is another text's
        kind = np.where(inside & punct[after], raw[after].astype(np.int64), 0)
        add(of[where], (raw[where].astype(np.int64) * 131 + kind) % 384)
        first = raw[starts]
        upper = (first >= 65) & (first <= 90)
        upper2 = np.where(ends - starts > 1, (raw[np.minimum(starts + 1, len(raw) - 1)] >= 65) & (raw[np.minimum(starts + 1, len(raw) - 1)] <= 90), False)
        add(rows, 384 + upper * 1 + upper2 * 2)
        add(rows, 388 + np.minimum(ends - starts, 23))
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
        add(rows, 412 + same * 1)
        seen = np.unique(np.stack([rows.astype(np.uint64), words]), axis=1) if len(words) < 64 else None
        distinct = np.bincount((seen[0] if seen is not None else _distinct_rows(rows, words)).astype(np.int64), minlength=n)
        total = np.bincount(rows, minlength=n)
        share = np.where(total > 0, distinct / np.maximum(total, 1), 1)
        length = np.clip(np.log2(np.maximum(total, 1)).astype(int), 0, 15)
        here = np.flatnonzero(total > 0)
        weight = np.maximum(total[here] / 4, 1).astype(np.float32)
        out[here, 420 + np.clip((share[here] * 8).astype(int), 0, 7)] += weight
        out[here, 430 + length[here]] += weight / 4
        breaks = np.flatnonzero(raw == 10)
        add(of[breaks], np.full(len(breaks), 450))
    return out


def _distinct_rows(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The row of each distinct (row, word)."""
    order = np.lexsort((words, rows))
    r, w = rows[order], words[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
    return r[new]


@dataclass
class Model:
    weight: np.ndarray  # inverse document frequency of each feature
    axes: np.ndarray  # FEATURES x LATENT
    vectors: np.ndarray  # labelled vectors, of length 1
    labels: np.ndarray  # of 0 and 1
    votes: np.ndarray  # so that both labels weigh as in the corpus
    prior: float


def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = counts * (100 / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    np.log1p(x, out=x)
    x *= weight
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def sampled(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> tuple[DataFrame, float]:
    """_h, doc_id, label and text of at most ``size`` ids of each label of labels(doc_id, label), and the share of label 1 in all of them.

    Only labels of ids that docs has count. Equal rows of labels count once; of several texts of an id the least is taken, so there are at most 2 * size rows.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("_h")).distinct()
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    cut = F.lit(0.0)
    for k, v in counts.items():
        cut = F.when(F.col("label") == k, F.lit(1.3 * size / v)).otherwise(cut)
    # about 1.3 times the rows wanted pass this cut, so no task ranks all rows of a label
    rank = F.row_number().over(Window.partitionBy("label").orderBy("_h", "doc_id"))
    chosen = known.where(F.col("_h") / 2.0**64 + 0.5 < cut).withColumn("_r", rank).where(F.col("_r") <= size)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    total = sum(counts.values())
    return texts.groupBy("_h", "doc_id", "label").agg(F.min("text").alias("text")), (counts.get(1, 0) / total if total else 0.5)


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of the sample, and the share of label 1."""
    rows, prior = sampled(docs, labels, size)
    return _in_order(rows.collect()), prior


def _in_order(rows: list) -> list[tuple[str, int]]:
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["_h"], r["doc_id"], r["label"], r["text"]))]


def fitted(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> Model | None:
    """The model of the sample, learned by one task of an executor, so the driver gets no more than the model."""
    rows, prior = sampled(docs, labels, size)

    def fit(key, table):
        model = learn(_in_order(table.drop_columns("_all").to_pylist()), prior)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(fit, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else None


def learn(labelled: list[tuple[str, int]], prior: float, latent: int = LATENT) -> Model | None:
    """Singular vectors of the sample by randomised subspace iteration with a fixed seed.

    Directions of next to no weight are rounding noise and are left out, and signs are fixed, so that the model doesn't depend on how many threads fit it.
    """
    if not labelled:
        return None
    texts, labels = pa.array([t for t, _ in labelled], pa.string()), np.array([y for _, y in labelled], np.int64)
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    counts = np.concatenate([count_features(b.column(0)) for b in tb.slices([batch])])
    seen = (counts > 0).sum(axis=0)
    weight = np.log((1 + len(labels)) / (1 + seen)).astype(np.float32) + 0.1
    weight[:SHAPES] += 1.5  # form tells more than single words
    x = weighted(counts, weight)
    x = x.astype(np.float64)
    k = min(latent, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], k + 8))
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, strength, v = np.linalg.svd(x @ q, full_matrices=False)
    k = max(1, min(k, int((strength > NOISE * strength[0]).sum())))
    axes = (q @ v.T)[:, :k]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    axes = axes.astype(np.float32)
    ones = max(int(labels.sum()), 1)
    zeros = max(len(labels) - int(labels.sum()), 1)
    votes = np.where(labels == 1, prior / ones, (1 - prior) / zeros).astype(np.float32)
    return Model(weight, axes, unit(x @ axes).astype(np.float32), labels, votes, float(prior))


def vote(model: Model | None, column: pa.Array) -> np.ndarray:
    """The score of each text: the share of label 1 among all neighbours' weights."""
    counts = count_features(column)
    if model is None:
        return np.full(len(counts), 0.5)
    y = unit(weighted(counts, model.weight) @ model.axes)
    out = np.empty(len(y))
    for i in range(0, len(y), BLOCK):
        cosine = y[i : i + BLOCK] @ model.vectors.T
        near = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True))) * model.votes
        out[i : i + BLOCK] = near @ model.labels.astype(np.float32) / near.sum(axis=1)
    out[counts.sum(axis=1) == 0] = model.prior
    return np.round(np.clip(out, 0, 1), 6)  # so that the place in a block doesn't show


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score for each row with doc_id and text."""
    kept = docs.sparkSession.sparkContext.broadcast(model)  # 2 * SAMPLE_DOCS vectors and FEATURES axes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            found = vote(kept.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def kept(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores ``threshold`` or more, with all their columns."""
    at = docs.columns.index("text")
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            yield batch.filter(pa.array(vote(broadcast.value, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
