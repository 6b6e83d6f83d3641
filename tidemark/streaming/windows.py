"""The operators that make sense on unbounded input, as Structured Streaming plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, keys: list[str], ts: str, value: str, seconds: int, late: str) -> DataFrame:
    """Counts and means of tumbling windows; rows later than the watermark are left out."""
    return (
        events.withWatermark(ts, late)
        .groupBy(*keys, F.window(ts, f"{seconds} seconds"))
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
        .select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "most")
    )


def sessions(events: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Stretches without a pause of ``gap``: interval merging for a stream."""
    return (
        events.withWatermark(ts, late)
        .groupBy(*keys, F.session_window(ts, gap))
        .agg(F.count("*").alias("n"))
        .select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def first_within(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key's row once within the watermark: a bounded memory of duplicates."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def operation_totals(operations: DataFrame, keys: list[str]) -> DataFrame:
    """Running totals of an operation log."""
    from tidemark.sources.logs import operation_counts

    return operation_counts(operations, keys)


def anchored_runs(events: DataFrame, key: str, ts: str, value: str, from_first: float, from_last: float, late: str, idle_ms: int) -> DataFrame:
    """(key, start, end, n) of runs of a stream; a run ends where the value leaves its first or its last one by more than allowed, or when the watermark is ``idle_ms`` past its end.

    The state of a key is its open run; rows of a micro-batch are folded in time order, rows
    older than the open run's end are left out.
    """
    kind = dict(events.dtypes)[key]
    state = "start double, end double, n long, first double, last double"

    def fold(k: tuple, batches: Iterator[pd.DataFrame], open_: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        run = list(open_.get) if open_.exists else None
        if open_.hasTimedOut:
            open_.remove()
            yield pd.DataFrame([(k[0], *run[:3])], columns=["key", "start", "end", "n"])
            return
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        for t, v in rows[["t", "v"]].itertuples(index=False):
            if run is not None and t < run[1]:
                continue
            if run is not None and abs(v - run[3]) <= from_first and abs(v - run[4]) <= from_last:
                run[1], run[2], run[4] = t, run[2] + 1, v
            else:
                if run is not None:
                    out.append((k[0], *run[:3]))
                run = [t, t, 1, v, v]
        if run is not None:
            open_.update(tuple(run))
            open_.setTimeoutTimestamp(max(int(run[1] * 1000) + idle_ms, open_.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "start", "end", "n"])

    rows = events.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(fold, f"key {kind}, start double, end double, n long", state, "append", GroupStateTimeout.EventTimeTimeout)
