"""Consecutive failures of each run, counted across micro-batches, and the point at which a run has to stop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# fixed value: consecutive failures after which a run stops
ABORT_AFTER = 12
# end of fixed values
STATE = "last long, calls long, failures long, streak long, longest long, stopped long"


def advanced(state: tuple[int, ...] | None, order: np.ndarray, failed: np.ndarray, limit: int) -> tuple[int, ...]:
    """(last, calls, failures, streak, longest, stopped) after further calls; stopped is 1 if the last call reached the limit.

    Calls at or before the last one were counted already, and those after a stop don't count.
    """
    last, calls, failures, streak, longest, stopped = state or (-(1 << 63), 0, 0, 0, 0, 0)
    at = np.argsort(order, kind="stable")
    order, failed = order[at], failed[at]
    fresh = (order > last) & np.concatenate([[True], order[1:] != order[:-1]]) if len(order) else np.zeros(0, bool)
    order, failed = order[fresh], failed[fresh]
    if stopped or not len(order):
        return last, calls, failures, streak, longest, stopped
    # how many failures in a row end at each call
    n = np.arange(len(failed))
    success = np.maximum.accumulate(np.where(failed, -1, n))
    run = np.where(failed, n - success + np.where(success < 0, streak, 0), 0)
    hit = np.flatnonzero(run >= limit)
    end = int(hit[0]) + 1 if len(hit) else len(run)
    return int(order[end - 1]), calls + end, failures + int(failed[:end].sum()), int(run[end - 1]), max(longest, int(run[:end].max())), int(len(hit) > 0)


def streaks(stream: DataFrame, key: str, order: str, failed: str, limit: int = ABORT_AFTER) -> DataFrame:
    """A stream of key, calls, failures, streak, longest, stopped (the call that reached the limit, null while the run goes on) and version (the last call), one row for each key of a batch.

    The state of a key is six numbers. Calls must come in their order from one batch to the next, as an append-only log has them; within a batch any order
    will do, and calls that come again change nothing. A task holds of one key's calls of one batch two numbers each; the size of a batch
    is the source's to bound.
    """
    kind = dict(stream.dtypes)[key]

    def count(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(f[order].to_numpy(np.int64), f[failed].to_numpy(bool)) for f in frames]
        now = advanced(state.get if state.exists else None, np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]), limit)
        state.update(now)
        last, calls, failures, streak, longest, stopped = now
        yield pd.DataFrame({key: [keys[0]], "calls": [calls], "failures": [failures], "streak": [streak], "longest": [longest], "stopped": [stopped], "version": [last]})

    thin = stream.select(key, F.col(order).cast("long").alias(order), F.coalesce(failed, F.lit(False)).cast("boolean").alias(failed)).where(F.col(key).isNotNull() & F.col(order).isNotNull())
    found = thin.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, calls long, failures long, streak long, longest long, stopped long, version long", STATE, "update", GroupStateTimeout.NoTimeout)
    return found.withColumn("stopped", F.when(F.col("stopped") == 1, F.col("version")))


def latest(log: DataFrame, key: str) -> DataFrame:
    """Of an append-only log of ``streaks`` the last row of each key."""
    rest = ["calls", "failures", "streak", "longest", "stopped"]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("version", "calls")).alias("_v")).select(key, "_v.*")


def going_on(runs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of runs that weren't stopped. found: output of ``latest``."""
    return runs.join(found.where("stopped is not null").select(key), key, "left_anti")
