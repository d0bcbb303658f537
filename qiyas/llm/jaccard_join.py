"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct word n-grams. Two sets link when the intersection is at
least ``SHARE`` percent of the union; the result is each document's component of links.
The join is exact.

Equal sets are one class. Classes with a common least hash, under any of ``ROUNDS`` orders,
are dealt to blocks of up to ``GROUP``, each with the bucket's first class, and all links
within a block are found at once; they make clusters, and a group is up to ``GROUP`` classes
of one cluster. Links inside a cluster tell nothing new, so what is left to find is links
between clusters, and no pairs inside a large cluster of near copies are ever listed.

For those, the matrix of tokens and groups is kept in rows. All tokens have one order: by the
number of classes that hold them, counted exactly in buckets of tokens, then by hash. Linked
sets share a token among the first few of each (a prefix whose length follows from the
threshold), so only prefixes are looked up: two clusters meet if they share such a token at
places that still allow a link, and the classes of the smaller ask the groups of the other. Then the overlap of the query with the union of
the group's tokens is bounded; only if it reaches the share of the query that a link needs is
the group opened, and its classes compared one by one until one links.

Tokens that a ``HEAVY`` share of ``SAMPLE`` classes hold come last in the order and aren't
counted, so no bucket gets a row of most classes. The sample (the least set_ids) only decides
the order; any order gives the same result.

Defined results: null or empty texts, and texts without words, have empty sets, link with
nothing and are components of their own; a text of fewer words than n has one n-gram, its
whole sequence; rows of equal doc_id are rows of their own; null doc_ids count only where
a component has no other; extra columns are not read; an empty table gives an empty result.
N-grams are told apart by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qiyas.llm import textbuf as tb
from qiyas.llm.bitmaps import Member, broadcast_bitmap
from qiyas.llm.components import components
from qiyas.llm.scratch import Scratch

WORDS, SHARE = 5, 75
ROUNDS, GROUP = 3, 64
#: Queries that one task compares with one group.
QUERIES = 256
#: Tokens that one task puts in order at once, and those that a task gathers before it deals them out.
BUCKET_TOKENS, GATHERED = 1_500_000, 1_000_000
#: Classes from which the heaviest tokens are known, and their least share.
SAMPLE, HEAVY = 4000, 0.005
COEFFICIENTS = tb.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
SEEDS = tb.mix(np.arange(1001, 1001 + ROUNDS, dtype=np.uint64))


def sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams."""
    raw, at = tb.utf8(column)
    n = len(at) - 1
    empty = np.zeros(0, np.uint64)
    if not len(raw):
        return [empty] * n
    low = tb.lower(raw)
    starts, ends, rows = tb.ascii_words(low, at)
    each = tb.span_hashes(tb.prefix_sums(low), starts, ends, tb.powers(len(low) + 1, tb.INVERSE))
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    grams = np.zeros(max(len(each) - words + 1, 0), np.uint64)
    for k in range(words):
        grams += each[k : k + len(grams)] * COEFFICIENTS[k]
    grams = tb.mix(grams + np.uint64(words))
    out = []
    for i in range(n):
        a, c = first[i], count[i]
        if c >= words:
            out.append(np.unique(grams[a : a + c - words + 1]))
        elif c:
            out.append(tb.mix(np.array([(each[a : a + c] * COEFFICIENTS[:c]).sum(dtype=np.uint64) + np.uint64(c)], np.uint64)))
        else:
            out.append(empty)
    return out


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def key_of(ids: list[bytes]) -> np.ndarray:
    """64 bits of each set_id."""
    return np.frombuffer(b"".join(ids), np.int64)[::2]


def needed(total: int) -> int:
    """The least intersection of two sets whose sizes add up to total."""
    return -(-total * SHARE // (100 + SHARE))


def probe_length(n: int) -> int:
    """So many first tokens of a set hold one of every set it links with."""
    return n - -(-n * SHARE // 100) + 1


def index_length(n: int) -> int:
    """The same, for sets that aren't smaller."""
    return n - needed(2 * n) + 1


def distinct_sets(batches: Iterator[pa.RecordBatch], position: int) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """Ids and sets of slices of documents, equal sets of a slice once, empty ones left out."""
    for batch in tb.slices(batches):
        found = {set_id(s): s for s in sets(batch.column(position)) if len(s)}
        yield list(found), list(found.values())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), n, set_id and class, 64 bits of it (null for the empty set), and the least hashes under each order."""
    names = [f"m{k}" for k in range(ROUNDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            found = sets(batch.column(1))
            least = [[int(tb.mix(s ^ seed).min().view(np.int64)) if len(s) else None for s in found] for seed in SEEDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array([len(s) for s in found], pa.int64()), pa.array(ids := [set_id(s) if len(s) else None for s in found], pa.binary()), pa.array([None if x is None else int(key_of([x])[0]) for x in ids], pa.int64()), *(pa.array(x, pa.int64()) for x in least)],
                ["doc_id", "tie", "n", "set_id", "class", *names],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, tie long, n long, set_id binary, class long, " + ", ".join(f"{m} long" for m in names))


def fetched(docs: DataFrame, wanted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """set_id and tokens (packed and sorted) of the wanted classes; a bitmap spares the texts of most others."""
    keys = scratch.table(wanted.select("set_id").distinct(), f"{name}_keys")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(key_of(ids) if ids else np.zeros(0, np.int64))], ["key"])

    bitmap = broadcast_bitmap(keys.mapInArrow(pack, "key long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = Member(bitmap)
        for ids, found in distinct_sets(batches, 0):
            use = np.flatnonzero(member(key_of(ids))) if ids else []
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in use], pa.binary()), pa.array([found[i].tobytes() for i in use], pa.binary())], ["set_id", "tokens"])

    every = docs.select("text").mapInArrow(run, "set_id binary, tokens binary")
    out = scratch.table(every.join(keys, "set_id", "left_semi").dropDuplicates(["set_id"]), name)
    bitmap.destroy()
    scratch.drop(f"{name}_keys")
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SHARE * (len(a) + len(b) - both)


def tokens(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def overlaps(found: list[np.ndarray], width: int = 1 << 15) -> np.ndarray:
    """The sizes of all intersections of a block of sets."""
    flat, owner = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    again = np.bincount(column)[column] > 1  # tokens of one set count for nothing
    column, owner = np.unique(column[again], return_inverse=True)[1], owner[again]
    out = np.zeros((len(found), len(found)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(found), width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def block_links(ids: list[bytes], found: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """A star for every component of the links inside a block of distinct sets."""
    size = np.array([len(x) for x in found])
    both = overlaps(found)
    link = 100 * both >= SHARE * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, True)
    label = np.arange(len(found))
    while True:
        least = np.where(link, label[None, :], len(found)).min(axis=1)
        if (least == label).all():
            return [(ids[i], ids[k]) for i, k in enumerate(label) if i != k]
        label = least


def similar_links(docs: DataFrame, classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """a, b: links that join what is linked within blocks of classes with a common least hash; and the heavy tokens, the heaviest last."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("round"), F.col(f"m{k}").alias("key")) for k in range(ROUNDS)]))
    each = classes.select("set_id", "n", keys.alias("k")).select("set_id", "n", "k.*")
    buckets = each.groupBy("round", "key").agg(F.min("set_id").alias("first"), F.max("set_id").alias("last"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("set_id")).alias("content"), F.sum("n").alias("tokens")).where("c > 1")
    # the same classes under several orders are one bucket
    parts = F.ceil(F.greatest(F.col("c") / (GROUP - 1), F.col("tokens") / BUCKET_TOKENS)).cast("int")
    buckets = scratch.table(buckets.dropDuplicates(["first", "last", "c", "content"]).select("round", "key", "first", parts.alias("parts")), "buckets")
    block = lambda part: F.xxhash64("round", "key", part).alias("block")
    dealt = each.join(buckets, ["round", "key"]).select(block(F.pmod(F.xxhash64("set_id", "round"), F.col("parts")).cast("int")), "set_id")
    firsts = buckets.where("parts > 1").select("round", "key", F.col("first").alias("set_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(block(F.col("part")), "set_id")
    blocks = scratch.table(dealt.union(firsts).distinct(), "blocks")
    sample = scratch.table(classes.select("set_id").orderBy("set_id").limit(SAMPLE), "sample")
    store = fetched(docs, blocks.select("set_id").union(sample), scratch, "block_sets")
    heavy = heavy_tokens(store.join(F.broadcast(sample), "set_id", "left_semi"))

    def compare(key, table):
        found = dict(zip(table.column("set_id").to_pylist(), (tokens(x.as_py()) for x in table.column("tokens")), strict=True))
        stars = block_links(list(found), list(found.values()))
        return pa.table({"a": pa.array([a for a, _ in stars], pa.binary()), "b": pa.array([b for _, b in stars], pa.binary())})

    links = scratch.table(blocks.join(store, "set_id").groupBy("block").applyInArrow(compare, "a binary, b binary"), "similar_links")
    scratch.drop("buckets", "blocks", "sample", "block_sets")
    return links, heavy


def heavy_tokens(sampled: DataFrame) -> np.ndarray:
    """Tokens that a HEAVY share of SAMPLE sets hold, by count, then by hash; at most 1 / HEAVY times a set's mean size."""

    def count(key, table):
        found, times = np.unique(np.concatenate([tokens(x.as_py()) for x in table.column("tokens")]), return_counts=True)
        use = np.flatnonzero(times >= max(HEAVY * SAMPLE, 2))
        use = use[np.lexsort((found[use], times[use]))]
        return pa.table({"heavy": pa.array([found[use].tobytes()], pa.binary())})

    rows = sampled.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(count, "heavy binary").collect()  # one row
    return tokens(bytes(rows[0]["heavy"])) if rows else np.zeros(0, np.uint64)


def bucket_of(found: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets follow the order of hashes."""
    return ((found >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


DEALT = "bucket int, classes binary, counts binary, tokens binary"


def dealt_tokens(docs: DataFrame, heavy, buckets: int) -> DataFrame:
    """Every set's tokens by bucket; a row holds those of many sets: the classes, how many tokens each has, and the tokens.

    Heavy tokens go to buckets below 0, a class's all to the same.
    """

    def rows(found: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        keys = key_of(list(found))
        flat, owner = np.concatenate(list(found.values())), np.repeat(np.arange(len(found)), [len(s) for s in found.values()])
        bucket = bucket_of(flat, buckets)
        if len(heavy.value):
            known = np.sort(heavy.value)
            last = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat
            bucket[last] = -1 - np.mod(keys[owner[last]], buckets)
        order = np.argsort(bucket, kind="stable")
        flat, owner, bucket = flat[order], owner[order], bucket[order]
        new = np.ones(len(flat), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        count, key, of = np.diff(np.append(start, len(flat))).astype(np.uint32), keys[owner[start]], bucket[start]
        there, at = np.unique(of, return_index=True)
        at = [*at.tolist(), len(of)]
        edge = [*start.tolist(), len(flat)]
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), cut(key), cut(count), pa.array([flat[edge[a] : edge[b]].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["bucket", "classes", "counts", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[bytes, np.ndarray] = {}
        size = 0
        for ids, found in distinct_sets(batches, 0):
            gathered.update(zip(ids, found, strict=True))
            size += sum(map(len, found))
            if size >= GATHERED:
                yield rows(gathered)
                gathered, size = {}, 0
        if gathered:
            yield rows(gathered)

    return docs.select("text").mapInArrow(run, DEALT)


def opened_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Class and token of every entry of rows of ``dealt_tokens``."""
    join = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]) if table.num_rows else np.zeros(0, kind)
    return np.repeat(join("classes", np.int64), join("counts", np.uint32)), join("tokens", np.uint64)


def once(found: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (token, class), by token."""
    order = np.lexsort((of, found))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], of[new]


#: A heavy token's count is its place among heavy tokens, above all others.
HEAVY_COUNT = 1 << 31


def postings(docs: DataFrame, members: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """The rows of the matrix: token, set_id, cluster, group, size n and place, of prefix tokens that several classes hold."""
    kept = docs.sparkSession.sparkContext.broadcast(heavy)

    def shared(key, table):
        tb.release()
        of, found = opened_rows(table)
        if key[0].as_py() < 0:
            found, of = once(found, of)
            order = np.argsort(kept.value, kind="stable")
            count = order[np.searchsorted(kept.value, found, sorter=order)] + HEAVY_COUNT
        else:
            order = np.argsort(found, kind="stable")
            found, of = found[order], of[order]
            again = np.zeros(len(found), bool)
            again[1:] = found[1:] == found[:-1]
            again[:-1] |= again[1:].copy()
            found, of = once(found[again], of[again])
            _, at, count = np.unique(found, return_inverse=True, return_counts=True)
            count = np.minimum(count, HEAVY_COUNT - 1)[at]
            use = count > 1
            found, of, count = found[use], of[use], count[use]
        shard = np.mod(of, buckets)
        order = np.argsort(shard, kind="stable")
        there, at = np.unique(shard[order], return_index=True)
        parts = [order[a:b] for a, b in zip(at, [*at[1:], len(order)])]
        cut = lambda x: pa.array([x[i].tobytes() for i in parts], pa.binary())
        return pa.table({"shard": pa.array(there, pa.int32()), "classes": cut(of), "tokens": cut(found), "counts": cut(count.astype(np.uint32))})

    def prefixes(left, right):
        tb.release()
        join = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in left.column(name)]) if left.num_rows else np.zeros(0, kind)
        of, found, count = join("classes", np.int64), join("tokens", np.uint64), join("counts", np.uint32)
        order = np.lexsort((found, count, of))
        of, found = of[order], found[order]
        key, n = right.column("class").to_numpy(), right.column("n").to_numpy()
        start, stop = np.searchsorted(of, key), np.searchsorted(of, key, side="right")
        # the first tokens of a set are those that no other holds; sets that share 64 bits of their ids keep every token
        alone = np.bincount(np.unique(key, return_inverse=True)[1], minlength=1)[np.unique(key, return_inverse=True)[1]] == 1 if len(key) else np.zeros(0, bool)
        own = np.where(alone, n - (stop - start), 0)
        most = np.where(alone, np.clip(n - -(-n * SHARE // 100) + 1 - own, 0, stop - start), stop - start)
        row = np.repeat(np.arange(len(key)), most)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
        place = np.where(alone[row], own[row] + rank, 0)
        take = pa.array(row)
        return pa.table({"token": pa.array(found[start[row] + rank].view(np.int64)), **{c: right.column(c).take(take) for c in ("set_id", "cluster", "group")}, "n": pa.array(n[row], pa.int32()), "place": pa.array(place, pa.int32())})

    told = dealt_tokens(docs, kept, buckets).groupBy("bucket").applyInArrow(shared, "shard int, classes binary, tokens binary, counts binary")
    known = members.select(F.pmod("class", F.lit(buckets)).cast("int").alias("shard"), "class", "n", "set_id", "cluster", "group")
    return told.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(prefixes, "token long, set_id binary, cluster long, group long, n int, place int")


def candidates(rows: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """query, group: classes and groups of two clusters that share a token where a link is still possible.

    Whole clusters meet first, one row for a token and cluster whatever its size; then the classes of the one with fewer
    are the queries and the groups of the other are asked.
    """
    # tokens of a single cluster, nearly all by now, have nothing to tell
    crossing = rows.groupBy("token").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a != b").select("token")
    met = scratch.table(rows.join(crossing, "token", "left_semi"), "crossing")
    # a cluster's rows for a token are one: its sizes, and the most tokens from there on
    side = lambda x: [F.min("n").alias(f"{x}least"), F.max("n").alias(f"{x}most"), F.max(F.col("n") - F.col("place")).alias(f"{x}left")]
    index = met.where(F.col("place") < F.col("n") - F.ceil(F.col("n") * 2 * SHARE / (100 + SHARE)) + 1)
    x = index.groupBy("token", F.col("cluster").alias("xc")).agg(*side("x"))
    y = met.groupBy("token", F.col("cluster").alias("yc")).agg(*side("y"))
    # the least sizes that the smaller and the larger set of a link can have
    smaller, larger = F.greatest("xleast", F.ceil(F.col("yleast") * SHARE / 100)), F.greatest("xleast", "yleast")
    fits = (F.col("xleast") <= F.col("ymost")) & (F.col("xmost") * 100 >= F.col("yleast") * SHARE) & (F.least("xleft", "yleft") * (100 + SHARE) >= (smaller + larger) * SHARE)
    both = x.join(y, "token").where((F.col("xc") != F.col("yc")) & fits).select(F.least("xc", "yc").alias("a"), F.greatest("xc", "yc").alias("b")).distinct()
    sizes = members.groupBy("cluster").agg(F.count("*").alias("k"))
    sized = both.join(sizes.withColumnsRenamed({"cluster": "a", "k": "ka"}), "a").join(sizes.withColumnsRenamed({"cluster": "b", "k": "kb"}), "b")
    fewer = F.col("ka") <= F.col("kb")
    turned = scratch.table(sized.select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("cluster"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("asked")), "met_clusters")
    queries = turned.join(members.select("cluster", F.col("set_id").alias("query")), "cluster")
    groups = members.select(F.col("cluster").alias("asked"), "group").distinct()
    return queries.join(groups, "asked").select("query", "group")


def dealt(pairs: DataFrame, members: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """group, part, set_id and asks: every group's classes, once for each part of its queries, and the queries."""
    load = pairs.groupBy("group").agg(F.count("*").alias("queries"))
    parts = load.select("group", F.ceil(F.col("queries") / QUERIES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")
    asked = pairs.join(parts, "group").select("group", part.alias("part"), F.col("query").alias("set_id"), F.lit(True).alias("asks"))
    there = members.join(parts, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "set_id", F.lit(False).alias("asks"))
    return scratch.table(asked.union(there), name)


def opened_links(docs: DataFrame, pairs: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: a query class and one class of a group that it links with, of every group that must be opened and has one."""
    both = dealt(pairs, members, scratch, "opened")
    store = fetched(docs, both, scratch, "group_sets")

    def compare(key, table):
        asks = table.column("asks").to_pylist()
        ids, found = table.column("set_id").to_pylist(), [tokens(x.as_py()) for x in table.column("tokens")]
        inside = [i for i, q in enumerate(asks) if not q]
        union = np.unique(np.concatenate([found[i] for i in inside])) if inside else np.zeros(0, np.uint64)
        out = []
        for i, q in enumerate(asks):
            if not q:
                continue
            query = found[i]
            if len(union) == 0 or 100 * len(np.intersect1d(query, union, assume_unique=True)) < SHARE * len(query):
                continue  # no class of the group can link
            out += next(([(ids[i], ids[j])] for j in inside if linked(query, found[j])), [])
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return both.join(store, "set_id").groupBy("group", "part").applyInArrow(compare, "a binary, b binary")


def components_of_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs, and set_id, component and first (the least doc_id) of every set that isn't empty."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    least = [f"m{k}" for k in range(ROUNDS)]
    signed = scratch.table(signatures(docs), "signed")
    classes = signed.where("set_id is not null").groupBy("set_id").agg(F.min("n").alias("n"), F.min("doc_id").alias("first"), F.min("class").alias("class"), *[F.min(m).alias(m) for m in least])
    classes = scratch.table(classes, "classes")
    links, heavy = similar_links(docs, classes, scratch)
    clusters = components(links, scratch, "clusters")
    of = classes.join(clusters.withColumnsRenamed({"node": "set_id"}), "set_id", "left").select("set_id", "class", "n", F.coalesce("component", "set_id").alias("component"))
    of = scratch.table(of, "of")
    size = of.groupBy("component").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")).where("groups > 1")
    part = F.coalesce(F.pmod(F.xxhash64("set_id"), F.col("groups")), F.lit(0)).cast("int")
    named = of.join(size, "component", "left").select("set_id", "class", "n", "component", F.xxhash64("component").alias("cluster"), F.xxhash64("component", part).alias("group"))
    members = scratch.table(named, "members")
    buckets = max(1, -(-(classes.agg(F.sum("n")).first()[0] or 0) // BUCKET_TOKENS))
    rows = scratch.table(postings(docs, members, heavy, buckets), "postings")
    pairs = scratch.table(candidates(rows, members, scratch), "candidates")
    scratch.drop("postings", "crossing")
    links = opened_links(docs, pairs, members.join(pairs.select("group").distinct(), "group", "left_semi"), scratch)
    name = members.select("set_id", "component")
    between = links.join(name.withColumnsRenamed({"set_id": "a", "component": "ca"}), "a").join(name.withColumnsRenamed({"set_id": "b", "component": "cb"}), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joint = components(scratch.table(between, "between"), scratch, "joint")
    scratch.drop("group_sets", "opened")
    last = members.join(joint.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("set_id", F.coalesce("whole", "component").alias("component"))
    return signed, last.join(classes.select("set_id", "first"), "set_id")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    signed, named = components_of_sets(docs)
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_set = named.join(ids, "component").select("set_id", "component_id")
    whole = signed.where("set_id is not null").join(by_set, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("set_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone)


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component: the least by doc_id (nulls last), set and hash of the text. Rows without words stay, too.

    Rows of equal doc_id and text are one document and stay together; of rows without an id that are equal in text one stays.
    """
    signed, named = components_of_sets(docs)
    worded = signed.where("set_id is not null").select("set_id", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "set_id", "tie").alias("row"))
    least = worded.groupBy("set_id").agg(F.min("row").alias("row"))
    stays = named.join(least, "set_id").groupBy("component").agg(F.min("row").alias("stays"))
    by_set = named.join(stays, "component").select("set_id", "stays")
    # row and stays hold the set, so equal rows are of one component
    gone = worded.join(by_set, "set_id").where("row <> stays").select("row.doc_id", "row.tie")
    # documents without an id that stay but stand in several rows
    several = worded.where("row.unknown").groupBy("row.tie").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(None).cast("long").alias("doc_id"), "tie")
    names = docs.columns
    at = lambda found: docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["tie"])
    one = several.join(gone.where("doc_id is null").select("tie"), "tie", "left_anti")
    copies = docs.where(docs["doc_id"].isNull()).join(one, F.xxhash64(docs["text"]) == one["tie"], "left_semi")
    first = copies.groupBy(F.xxhash64("text").alias("tie")).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")).select("row.*")
    without = gone.unionByName(several).distinct()
    return docs.join(without, at(without), "left_anti").select(*names).unionByName(first)
