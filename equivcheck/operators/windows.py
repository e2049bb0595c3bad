"""Tumbling event-time windows, global or keyed, in batch and in streaming.

A batch frame carries event time as a bigint of epoch milliseconds and groups
on ``ts - pmod(ts, size)``: one long as grouping key instead of a struct of two
timestamps, with the same epoch-aligned half-open windows as ``F.window``.  A
streaming frame carries it as the watermarked timestamp ``event_time`` and must
go through ``F.window``, else the watermark is lost between two aggregations.

A watermark starts at the epoch and takes everything before it as late, so the
streaming time runs ``STREAM_SHIFT_MS`` ahead of ``ts``; windows are aligned to
the unshifted epoch all the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Milliseconds per time unit.
UNIT_MS = {
    "milliseconds": 1,
    "seconds": 1_000,
    "minutes": 60_000,
    "hours": 3_600_000,
    "days": 86_400_000,
}


STREAM_SHIFT_MS = 2**47  # some 4,459 years


def stream_time(ts: Column) -> Column:
    """Event time of a stream from epoch milliseconds."""
    return F.timestamp_millis(ts + F.lit(STREAM_SHIFT_MS).cast("bigint"))


def _stream_window(time: str, size_ms: int) -> Column:
    size = f"{size_ms} milliseconds"
    return F.window(time, size, size, f"{STREAM_SHIFT_MS % size_ms} milliseconds")


def millis(amount: int, unit: str) -> int:
    return amount * UNIT_MS[unit]


def event_millis(ts: Column, unit: str) -> Column:
    """An integer time in ``unit`` since the epoch, as epoch milliseconds."""
    return ts.cast("bigint") * F.lit(UNIT_MS[unit]).cast("bigint")


def window_start(ts: Column, size_ms: int) -> Column:
    return ts - F.pmod(ts, F.lit(size_ms).cast("bigint"))


def tumbling(
    df: DataFrame, size_ms: int, aggs: dict[str, Column], keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Aggregate per window (and key).

    Batch result: ``start, end, *keys, *aggs``.  Streaming result: ``window,
    *keys, *aggs``; ``with_bounds`` turns it into the batch form.
    """
    columns = [c.alias(name) for name, c in aggs.items()]
    if df.isStreaming:
        return df.groupBy(_stream_window("event_time", size_ms), *keys).agg(*columns)
    start = window_start(F.col(ts), size_ms)
    grouped = df.where(F.col(ts).isNotNull()).groupBy(start.alias("start"), *keys)
    end = (F.col("start") + F.lit(size_ms).cast("bigint")).alias("end")
    return grouped.agg(*columns).select("start", end, *keys, *aggs)


def rewindow(
    df: DataFrame, size_ms: int, aggs: dict[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Window the result of ``tumbling`` again, by the start of its windows."""
    if df.isStreaming:
        columns = [c.alias(name) for name, c in aggs.items()]
        return df.groupBy(_stream_window("window", size_ms), *keys).agg(*columns)
    return tumbling(df, size_ms, aggs, keys, ts="start")


def with_bounds(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Final projection: window bounds in epoch milliseconds, keys, values."""
    if df.isStreaming:
        shift = F.lit(STREAM_SHIFT_MS).cast("bigint")
        bounds = [(F.unix_millis(f"window.{b}") - shift).alias(b) for b in ("start", "end")]
    else:
        bounds = [F.col("start"), F.col("end")]
    return df.select(*bounds, *keys, *[c.alias(name) for name, c in values.items()])
