"""Choosing documents so that sources reach target shares, where documents may belong to several sources.

Documents with the same set of sources form a pattern, which is one node with its words. A minimum-cost flow routes
words of patterns to the quotas of their sources: the first use of a pattern's words costs nothing, each further one more
than the one before, up to ``MOST`` uses. As these costs rise by level and hang on patterns alone, the flow is found
by levels: a largest flow with every pattern used once at most, enlarged by paths that may use it twice, and so on. Patterns that share no
source, not even through others, are separate problems, each solved by a task of its own; its input is one row a pattern.

A pattern that has to give T of its W words gives each document T div W times, and documents of T mod W words
once more: those first in the order of a seeded hash; the one at which the words run out gives only its first words. That one is found
by sums over bins of the hash, so no pattern's documents are sorted in one task.

Targets: sources in order of their code points, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` times all words; what is above
MOST times a source's own words is shared among the others by weight until nothing is.

Defined results: a document of null text has no words and gives none; one without sources gives none; of no words at all every target is 0;
rows of equal id and text (or of null ids and equal text) give equally many words; an empty table gives an empty one; extra columns are not read. Reruns agree: nothing depends on the order of rows.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qiyas.llm.components import components
from qiyas.llm.scratch import Scratch
from qiyas.operators.numbering import numbered

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = "7"
#: Bits of a document's place in the seeded order, and of a bin of them.
PLACE, BIN = 60, 12


def words(text: Column) -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def place(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A whole number below 2**PLACE by md5, the same on every engine."""
    known = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(known), 1, PLACE // 4), 16, 10).cast("long")


def named(source: Column) -> Column:
    """A source as a value that is never null and sorts by code points, null last."""
    return F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def quotas(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, number, source_size and target of every source of docs(sources, size)."""
    sizes = docs.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    order = numbered(sizes, ["source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    table = scratch.table(order.select("source", "number", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("most")), "sources")
    total = docs.agg(F.sum("size")).first()[0] or 0
    held, weighs = 0, table.agg(F.sum("weight")).first()[0] or 1
    while True:  # one round for each time that sources reach their limit; a row each
        level = lambda: F.col("weight") * (share * total - held) / weighs  # noqa: E731, B023
        below = F.col("most") < level()
        now = table.agg(F.coalesce(F.sum(F.when(below, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~below, F.col("weight"))), F.lit(0))).first()
        if (now[0], now[1]) == (held, weighs) or not now[1]:
            break
        held, weighs = now
    return table.select("source", "number", "source_size", F.least(F.col("most").cast("double"), level()).alias("target"))


def routed(sizes: list[int], sources: list[list[int]], quota: dict[int, int], most: int = MOST) -> list[dict[int, int]]:
    """For each pattern the words that go to each of its sources: of all largest flows one of least cost."""
    flow: list[dict[int, int]] = [dict.fromkeys(s, 0) for s in sources]
    left = dict(quota)
    givers: dict[int, list[int]] = {}
    for p, s in enumerate(sources):
        for k in s:
            givers.setdefault(k, []).append(p)
    for level in range(1, most + 1):
        spare = [level * w - sum(f.values()) for w, f in zip(sizes, flow, strict=True)]
        for p, s in enumerate(sources):  # what goes without a detour
            for k in s:
                n = min(spare[p], left[k])
                flow[p][k], spare[p], left[k] = flow[p][k] + n, spare[p] - n, left[k] - n
        for start in range(len(sizes)):
            while spare[start] > 0 and (path := _path(start, sources, givers, flow, left)):
                # p gives to k, and whoever gave to k gives that much to the next source instead
                n = min([spare[start], left[path[-1][1]], *(flow[p][k] for (_, k), (p, _) in zip(path, path[1:], strict=False))])
                for (p, k), nxt in zip(path, [*path[1:], None], strict=True):
                    flow[p][k] += n
                    if nxt is not None:
                        flow[nxt[0]][k] -= n
                spare[start], left[path[-1][1]] = spare[start] - n, left[path[-1][1]] - n
    return flow


def _path(start: int, sources: list[list[int]], givers: dict[int, list[int]], flow: list[dict[int, int]], left: dict[int, int]) -> list[tuple[int, int]] | None:
    """The shortest path (pattern, source), ... from a pattern to a source with room."""
    came: dict[int, tuple[int, int] | None] = {start: None}
    reached: set[int] = set()
    queue = deque([start])
    while queue:
        p = queue.popleft()
        for k in sources[p]:
            if k in reached:
                continue
            reached.add(k)
            if left[k] > 0:
                path, step = [(p, k)], came[p]
                while step is not None:
                    path.append(step)
                    step = came[step[0]]
                return path[::-1]
            for other in givers[k]:
                if other not in came and flow[other][k] > 0:
                    came[other] = (p, k)
                    queue.append(other)
    return None


def flows(patterns: DataFrame, quota: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """sources and given (words) of each pattern. patterns: sources, size. quota: source, number, target."""
    ends = patterns.select("sources", "size", F.explode("sources").alias("source")).join(quota.select("source", "number", F.round("target").cast("long").alias("quota")), "source")
    nodes = scratch.table(ends.groupBy("sources", "size").agg(F.sort_array(F.collect_list(F.struct("number", "quota"))).alias("ends")), "nodes")
    links = nodes.where(F.size("ends") > 1).select(F.col("ends")[0]["number"].alias("a"), F.explode("ends").alias("e")).select("a", F.col("e.number").alias("b")).where("a <> b")
    joined = nodes.withColumn("node", F.col("ends")[0]["number"])
    if links.isEmpty():
        joined = joined.withColumn("component", F.col("node"))
    else:
        joined = joined.join(components(links, scratch, "sources-of"), "node", "left").withColumn("component", F.coalesce("component", "node"))

    def solve(key, table):
        rows = table.column("ends").to_pylist()
        quota = {e["number"]: e["quota"] for r in rows for e in r}
        found = routed(table.column("size").to_pylist(), [[e["number"] for e in r] for r in rows], quota, most)
        return pa.table({"sources": table.column("sources"), "given": pa.array([sum(f.values()) for f in found], pa.int64())})

    kind = "sources array<struct<none: boolean, name: string>>, given long"
    return joined.select("component", "sources", "size", "ends").groupBy("component").applyInArrow(solve, kind)


def chosen(docs: DataFrame, given: DataFrame, scratch: Scratch) -> DataFrame:
    """sources, times, low, need and block of each pattern: its documents are given ``times`` times and those with place < low once more; those of place low have ``block`` words, of which ``need`` are given."""
    state = given.select("sources", F.floor(F.col("given") / F.col("size")).cast("long").alias("times"), (F.col("given") % F.col("size")).alias("need"), F.lit(0).cast("long").alias("low"))
    state = scratch.table(state, "bins0")
    w = Window.partitionBy("sources").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = PLACE - BIN
    for shift in (first, first - BIN):
        inside = docs.join(state, "sources").where(F.shiftright("place", shift + BIN) == F.shiftright("low", shift + BIN))
        bins = inside.groupBy("sources", F.shiftright("place", shift).alias("bin"), "times", "need").agg(F.sum("size").alias("n"))
        last = bins.withColumn("upto", F.sum("n").over(w)).where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("n") <= F.col("need")))
        state = scratch.table(last.select("sources", "times", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), F.shiftleft("bin", shift).alias("low")), f"bins{shift}")
    shift = first - BIN
    # the rows of one bin of a 2**24th of the places
    here = docs.join(state, "sources").where(F.shiftright("place", shift) == F.shiftright("low", shift)).groupBy("sources", "times", "need", "place").agg(F.sum("size").alias("block"))
    upto = F.sum("block").over(Window.partitionBy("sources").orderBy("place"))
    at = here.withColumn("before", upto - F.col("block")).where((F.col("before") <= F.col("need")) & (F.col("before") + F.col("block") > F.col("need")))
    return scratch.table(at.select("sources", "times", F.col("place").alias("low"), (F.col("need") - F.col("before")).alias("need"), "block"), "chosen")


def mixed(docs: DataFrame, sources: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sources, size, taken) for each row of docs, and (source, number, source_size, target).

    ``sources`` is an array of a document's source names, null among them if need be; repeated names count once. In the
    result they are structs, see ``named``.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    of = F.array_sort(F.array_distinct(F.transform(sources, named)))
    thin = docs.select("doc_id", F.coalesce(of, F.array().cast("array<struct<none: boolean, name: string>>")).alias("sources"), words(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text"), seed).alias("place"))
    thin = scratch.table(thin, "documents")
    quota = scratch.table(quotas(thin, scratch, weights, share, most), "quotas")
    patterns = scratch.table(thin.where(F.size("sources") > 0).groupBy("sources").agg(F.sum("size").alias("size")).where("size > 0"), "patterns")
    given = scratch.table(flows(patterns, quota, scratch, most).join(patterns, "sources"), "given")
    plan = chosen(thin, given, scratch)
    part = F.call_function("div", F.col("size") * F.col("need"), F.col("block"))
    once_more = F.when(F.col("place") < F.col("low"), F.col("size")).when(F.col("place") == F.col("low"), part).otherwise(0)
    taken = F.coalesce(F.col("size") * F.col("times") + once_more, F.lit(0).cast("long"))
    return thin.join(plan, "sources", "left").select("doc_id", "sources", "size", taken.alias("taken")), quota
